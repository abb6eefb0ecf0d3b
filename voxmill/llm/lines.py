"""Line dedup by a log-template tree, in DataFrame functions only.

A line goes to the leaf of its token count and first tokens, tokens with digits being variable
fields. In a leaf, a token that few lines have at its place is a variable field too; what is left
is the line's template. A template that recurs across texts is boilerplate and all its lines are
dropped. Exact copies of a text count once, and stay for the near-duplicate stage. On request it
must recur between different neighbours instead, or may do either.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxmill.llm.shared import stored

FIELD = "<*>"
_DIGITS = r"[^ 0-9]*+[0-9][^ ]*"


def _spaced(lines: Column) -> Column:
    """Lines with tokens joined by one space. Each costly step runs only on the lines that need it."""
    lines = F.transform(lines, lambda x: F.trim(F.when(x.rlike(r"[\x09-\x0D]"), F.translate(x, "\t\x0b\x0c\r", "    ")).otherwise(x)))
    return F.transform(lines, lambda x: F.when(F.contains(x, F.lit("  ")), F.regexp_replace(x, " +", " ")).otherwise(x))


def _masked(spaced: Column) -> Column:
    return F.when(spaced.rlike("[0-9]"), F.regexp_replace(spaced, _DIGITS, FIELD)).otherwise(spaced)


def _count(spaced: Column) -> Column:
    """Tokens, by the spaces between them."""
    return F.when(spaced == "", 0).otherwise(F.octet_length(spaced) - F.octet_length(F.replace(spaced, F.lit(" "), F.lit(""))) + 1)


def _row_keys(doc_id: str, text: str) -> list[Column]:
    """128 bits of id and text; rows that repeat both share every decision."""
    body = F.coalesce(F.col(text), F.lit(""))
    return [F.xxhash64(F.col(doc_id), body).alias("k1"), F.xxhash64(body, F.lit(1), F.col(doc_id)).alias("k2")]


def tree_lines(docs: DataFrame, depth: int = 3, neighbours: bool = True, doc_id="doc_id", text="text") -> DataFrame:
    """``k1, k2, line_no, masked, leaf, body``: every line that has tokens; body hashes the text. With ``neighbours`` also ``around``, of both neighbours' leaves."""
    body = F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("body")
    rows = docs.select(*_row_keys(doc_id, text), body, F.transform(_spaced(F.split(F.coalesce(F.col(text), F.lit("")), "\n")), _masked).alias("lines"))
    code = F.transform("lines", lambda x: F.xxhash64(_count(x), F.substring_index(x, " ", depth)))
    rows = rows.withColumn("code", code)
    if not neighbours:
        rows = rows.withColumn("each", F.arrays_zip(F.col("lines").alias("masked"), F.col("code").alias("leaf")))
        rows = rows.select("k1", "k2", "body", F.posexplode("each").alias("line_no", "x")).filter("x.masked <> ''")
        return rows.select("k1", "k2", "line_no", "x.masked", "x.leaf", "body")
    none = F.array(F.lit(0).cast("long"))
    rows = rows.withColumn("each", F.arrays_zip(F.col("lines").alias("masked"), F.col("code").alias("leaf"), F.concat(none, "code").alias("before"),
                                                F.concat(F.slice("code", F.lit(2), F.greatest(F.size("code") - 1, F.lit(0))), none).alias("after")))
    rows = rows.select("k1", "k2", "body", F.posexplode("each").alias("line_no", "x")).filter("x.masked <> ''")
    return rows.select("k1", "k2", "line_no", "x.masked", "x.leaf", "body", F.xxhash64("x.before", "x.after").alias("around"))


def recurring_lines(docs: DataFrame, support: int = 10, depth: int = 3, constant: float = 0.6, spread: float | None = None,
                    between: float | None = None, doc_id="doc_id", text="text") -> DataFrame:
    """``k1, k2, line_nos``: the lines of recurring templates by row.

    ``support``: lines a token needs at its place to be constant, and different texts or neighbours a
    template needs; ``constant``: share of constant tokens a template needs; ``spread``: neighbours as
    a share of its lines, or None to count different texts alone, whatever stands around the line;
    ``between``: without ``spread``, templates whose neighbours are many and this share of their lines go too. A leaf with fewer lines than ``support`` can hold no such template, which is exact.
    """
    share = between if spread is None else spread
    places = (["body"] if spread is None else []) + (["around"] if share is not None else [])
    lines = tree_lines(docs, depth, share is not None, doc_id, text)
    leaves = lines.groupBy("leaf").agg(F.count(F.lit(1)).alias("c")).filter(F.col("c") >= support).select("leaf")
    lines = stored(lines.join(leaves, "leaf", "left_semi"), "leaf-lines")
    kinds = lines.groupBy("leaf", "masked").agg(F.count(F.lit(1)).alias("c"))
    parts = kinds.select("leaf", "masked", "c", F.posexplode(F.split("masked", " ")).alias("place", "token"))
    known = parts.groupBy("leaf", "place", "token").agg(F.sum("c").alias("c")).filter(F.col("c") >= support).select("leaf", "place", "token", F.lit(1).alias("known"))
    fields = parts.drop("c").join(known, ["leaf", "place", "token"], "left")
    shape = F.transform(F.array_sort(F.collect_list(F.struct("place", F.when(F.col("known") == 1, F.col("token")).otherwise(FIELD).alias("token")))), lambda x: x["token"])
    templates = (fields.groupBy("leaf", "masked").agg(F.array_join(shape, " ").alias("template"), F.avg(F.coalesce("known", F.lit(0))).alias("held"))
                 .filter(F.col("held") >= constant).select("leaf", "masked", F.xxhash64("leaf", "template").alias("t1"), F.xxhash64("template", "leaf").alias("t2")))
    # the line's text served its purpose; its template is all that goes on
    found = stored(lines.join(templates, ["leaf", "masked"]).select("k1", "k2", "line_no", "t1", "t2", *places), "templated")
    # combined by what counts once, so a hot template is one row for each text or neighbourhood
    often = [found.groupBy("t1", "t2", place).agg(F.count(F.lit(1)).alias("c"))
             .groupBy("t1", "t2").agg(F.count(F.lit(1)).alias("places"), F.sum("c").alias("lines"))
             .filter((F.col("places") >= support) & (F.col("places") >= (share if place == "around" else 0.0) * F.col("lines"))).select("t1", "t2")
             for place in places]
    return found.join(often[0] if len(often) == 1 else often[0].unionByName(often[1]), ["t1", "t2"], "left_semi").groupBy("k1", "k2").agg(F.collect_set("line_no").alias("line_nos"))


def _kept(docs: DataFrame, doc_id: str, text: str, rule: dict) -> DataFrame:
    """``row`` (all columns of ``docs``), ``kept``, ``n_lines``, ``n_dropped``; the row's own columns can clash with nothing here."""
    found = recurring_lines(docs, doc_id=doc_id, text=text, **rule)
    rows = docs.select(F.struct(*docs.columns).alias("row"), *_row_keys(doc_id, text), F.split(F.coalesce(F.col(text), F.lit("")), "\n").alias("lines"))
    rows = rows.join(found, ["k1", "k2"], "left")
    # a set is taken from the line numbers and each kept line is looked up by its place: linear in lines
    places = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), "line_nos")
    kept = F.array_join(F.transform(places, lambda i: F.get("lines", i)), "\n")
    return rows.select("row", F.when(F.col("line_nos").isNull(), F.col("row")[text]).otherwise(kept).alias("kept"),
                       F.size("lines").alias("n_lines"), F.coalesce(F.size("line_nos"), F.lit(0)).alias("n_dropped"))


def drop_recurring(docs: DataFrame, doc_id="doc_id", text="text", **rule) -> DataFrame:
    """``docs`` with the columns ``kept_text, n_lines, n_dropped`` added; columns of ``docs`` with these names give way.

    Every row stays; a text that is all boilerplate becomes empty. Lines without tokens are never
    templates. A null text counts as one empty line and stays null. Rows that repeat id and text get the same.
    """
    own = [c for c in docs.columns if c not in ("kept_text", "n_lines", "n_dropped")]
    return _kept(docs, doc_id, text, rule).select(*[F.col("row")[c].alias(c) for c in own], F.col("kept").alias("kept_text"), "n_lines", "n_dropped")


def cleaned(docs: DataFrame, doc_id="doc_id", text="text", n_chars="n_chars", **rule) -> DataFrame:
    """``docs`` with boilerplate lines out of ``text``: the same rows and columns.

    ``n_chars``, where there is such a column, follows the texts that changed; all else stays, whatever its name."""
    changed = {text: F.col("kept")}
    if n_chars in docs.columns:
        changed[n_chars] = F.when(F.col("n_dropped") > 0, F.length("kept")).otherwise(F.col("row")[n_chars]).cast(docs.schema[n_chars].dataType)
    return _kept(docs, doc_id, text, rule).select(*[changed.get(c, F.col("row")[c]).alias(c) for c in docs.columns])
