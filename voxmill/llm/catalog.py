"""The operators bound to the test tables, one query each, with check SQL where SQL can state it."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxmill.llm import alignment, forest, language, leaks, lines, merkle, mixing, pairs, search, substrings, tokens, toxicity, warc
from voxmill.llm.shared import remainder

QUERIES = {}
CHECKS = {}


def query(name: str, sql: str | None = None):
    def wrap(fn):
        QUERIES[name] = fn
        if sql is not None:
            CHECKS[name] = sql
        return fn
    return wrap


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def tokenizer_file(name: str) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


@query("op1_language_model")
def op1(spark: SparkSession, folder: str) -> DataFrame:
    """Every document under a backoff model of those that are not held out."""
    held_out = remainder("doc_id", 7) == 2
    scored = language.score(table(spark, folder, "documents"), ~held_out)
    return scored.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


MIX_SQL = """
    WITH RECURSIVE t AS (SELECT doc_id, coalesce(source, '') AS source, coalesce(text, '') AS body FROM {docs}),
    r AS (SELECT doc_id, source, len(regexp_extract_all(body, '[^\\x20\\x09-\\x0D]+')) AS n_tokens,
                 ('0x' || substr(md5('0/' || coalesce(doc_id::VARCHAR, '') || '/' || md5(body)), 1, 12))::BIGINT AS h FROM t),
    s AS (SELECT source, sum(n_tokens)::BIGINT AS tokens FROM r GROUP BY 1),
    g AS (SELECT i, source, tokens, pow(tokens / (SELECT sum(tokens) FROM s)::DOUBLE, i / 4096.0) AS p
          FROM s, range(0, 4097) AS x(i) WHERE tokens > 0),
    w AS (SELECT i, source, tokens, p / sum(p) OVER (PARTITION BY i) AS w FROM g),
    e AS (SELECT i, -sum(w * ln(w)) >= 0.98 * ln(count(*)) - 1e-9 AS even,
                 bool_and(w * (SELECT sum(tokens) FROM s) <= 4.0 * tokens + 1e-6) AS few FROM w GROUP BY i),
    c AS (SELECT greatest(max(i) FILTER (even), coalesce(min(i) FILTER (few), 4096)) AS i FROM e),
    plan AS (SELECT source, greatest(1, -((-tokens) // 1048576)) AS blocks, x // tokens AS whole, x % tokens AS rest
             FROM (SELECT source, tokens, floor(w * (SELECT sum(tokens) FROM s) + 0.5)::BIGINT AS x FROM w JOIN c USING (i))
             UNION ALL SELECT source, 1, 0, 0 FROM s WHERE tokens = 0),
    b AS (SELECT r.*, h % blocks AS block, whole, rest FROM r JOIN plan USING (source)),
    k AS (SELECT source, block, whole, rest, sum(n_tokens) AS tokens, unnest(range(0, whole + 1)) AS epoch FROM b GROUP BY 1, 2, 3, 4),
    o AS (SELECT *, ('0x' || substr(md5('0/' || epoch || '/' || source || '/' || block), 1, 12))::BIGINT AS m FROM k),
    q AS (SELECT *, row_number() OVER (PARTITION BY source, epoch ORDER BY m, block) - 1 AS place,
                 sum(tokens) OVER (PARTITION BY source, epoch ORDER BY m, block) AS upto FROM o),
    l AS (SELECT source, block, epoch, place, tokens, CASE WHEN epoch < whole THEN tokens ELSE rest - upto + tokens END AS room, epoch < whole AS every FROM q),
    d AS (SELECT b.doc_id, b.source, b.n_tokens, l.epoch, l.block, l.place, room, tokens,
                 sum(b.n_tokens) OVER (PARTITION BY b.source, l.block, l.epoch ORDER BY b.h, b.n_tokens, b.doc_id) AS upto
          FROM b JOIN l ON b.source = l.source AND b.block = l.block WHERE every OR room > 0)
    SELECT doc_id, source, n_tokens::BIGINT AS n_tokens, epoch::BIGINT AS epoch, block::BIGINT AS block, place::INTEGER AS place
    FROM d WHERE room >= tokens OR upto <= room"""

LINES_SQL = """
    t AS (SELECT doc_id, coalesce(text, '') AS body FROM {docs}),
    l0 AS (SELECT doc_id, body, string_split(body, chr(10)) AS ls FROM t),
    l1 AS (SELECT doc_id, body, unnest(ls) AS line, generate_subscripts(ls, 1) - 1 AS line_no FROM l0),
    l2 AS (SELECT *, regexp_replace(line, '[^\\x20\\x09-\\x0D0-9]*[0-9][^\\x20\\x09-\\x0D]*', '<*>', 'g') AS masked FROM l1),
    l3 AS (SELECT *, regexp_extract_all(masked, '[^\\x20\\x09-\\x0D]+') AS toks FROM l2),
    l4 AS (SELECT *, len(toks) AS n, len(toks)::VARCHAR || chr(1) || array_to_string(toks[1:3], chr(1)) AS leaf FROM l3),
    l5 AS (SELECT *, coalesce(lag(leaf) OVER u, '') || chr(2) || coalesce(lead(leaf) OVER u, '') AS around FROM l4
           WINDOW u AS (PARTITION BY doc_id, body ORDER BY line_no)),
    ln AS (SELECT * FROM l5 WHERE n > 0),
    kinds AS (SELECT leaf, masked, any_value(toks) AS toks, count(*) AS c FROM ln
              WHERE leaf IN (SELECT leaf FROM ln GROUP BY 1 HAVING count(*) >= 10) GROUP BY 1, 2),
    parts AS (SELECT leaf, masked, c, unnest(toks) AS token, generate_subscripts(toks, 1) AS place FROM kinds),
    held AS (SELECT *, sum(c) OVER (PARTITION BY leaf, place, token) >= 10 AS known FROM parts),
    shapes AS (SELECT leaf, masked, string_agg(CASE WHEN known THEN token ELSE '<*>' END, ' ' ORDER BY place) AS template FROM held
               GROUP BY 1, 2 HAVING avg(known::INTEGER) >= 0.6),
    found AS (SELECT doc_id, body, line_no, around, leaf, template FROM ln JOIN shapes USING (leaf, masked)),
    often AS (SELECT leaf, template FROM found GROUP BY 1, 2 HAVING count(DISTINCT body) >= 10
              OR (count(DISTINCT around) >= 10 AND count(DISTINCT around) >= 0.5 * count(*))),
    gone AS (SELECT doc_id, body, line_no FROM found JOIN often USING (leaf, template)),
    kept AS (SELECT doc_id, body, count(*) AS n_lines, count(*) FILTER (gone.line_no IS NOT NULL) AS n_dropped,
                    coalesce(string_agg(line, chr(10) ORDER BY line_no) FILTER (gone.line_no IS NULL), '') AS kept_text
             FROM l1 LEFT JOIN gone USING (doc_id, body, line_no) GROUP BY 1, 2)"""


@query("op2_mixing", MIX_SQL.format(docs="documents"))
def op2(spark: SparkSession, folder: str) -> DataFrame:
    """Documents drawn so that sources have their temperature weights."""
    return mixing.mix(table(spark, folder, "documents"))


@query("op3_decontamination")
def op3(spark: SparkSession, folder: str) -> DataFrame:
    """Which document leaks which benchmark item, and where."""
    return leaks.contaminated(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query("op4_line_dedup", f"""WITH {LINES_SQL.format(docs="documents")}
    SELECT doc_id, n_lines::INTEGER AS n_lines, n_dropped::INTEGER AS n_dropped, sha256(kept_text) AS kept_sha256 FROM kept""")
def op4(spark: SparkSession, folder: str) -> DataFrame:
    """Every document without its boilerplate lines."""
    kept = lines.drop_recurring(table(spark, folder, "documents"), between=0.5)
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("kept_text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


@query("op5_token_counts")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    """Tokens of every document as word_bpe_49k counts them."""
    return tokens.token_counts(table(spark, folder, "documents"), tokenizer_file("word_bpe_49k.json"))


@query("op6_substring_dedup", """
    WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
    s AS (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d WHERE len(w) >= 20),
    n AS (SELECT doc_id, i, row_number() OVER (PARTITION BY array_to_string(w[i:i + 19], ' ') ORDER BY doc_id, i) AS r FROM s),
    g AS (SELECT DISTINCT doc_id, i + k AS j FROM n, range(0, 20) AS x(k) WHERE r > 1),
    e AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS j FROM d),
    k AS (SELECT doc_id, count(g.j) AS n_removed, string_agg(word, ' ' ORDER BY j) FILTER (g.j IS NULL) AS kept
          FROM e LEFT JOIN g USING (doc_id, j) GROUP BY 1)
    SELECT doc_id, len(w) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
    FROM d LEFT JOIN k USING (doc_id)""")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    """Every document without the words of repeated 20-word windows."""
    kept = substrings.drop_repeats(table(spark, folder, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


@query("op7_jaccard_join")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    """Every document with its class, links and group at similarity 0.8 of five-word shingles."""
    return pairs.jaccard_groups(table(spark, folder, "documents"))


def toxicity_machine(docs: DataFrame, labels: DataFrame, positives: int = 4000, negatives: int = 8000) -> toxicity.Machine:
    """Fitted on at most so many labelled rows, none of those that are held out."""
    return toxicity.fit(toxicity.sample(docs, labels, remainder("doc_id", 3) != 1, positives, negatives))


@query("op8_toxicity")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    """The toxicity score of every document."""
    docs = table(spark, folder, "documents")
    scored = toxicity.score(docs, toxicity_machine(docs, table(spark, folder, "labels")))
    return scored.select("doc_id", (remainder("doc_id", 3) == 1).alias("held_out"), "score",
                         F.when(F.col("score") >= 0.7, 1).otherwise(0).alias("predicted"))


@query("op9_top_k_search", """
    WITH t AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
    p AS (SELECT doc_id, dl, term, count(*) AS tf FROM (SELECT doc_id, len(w) AS dl, unnest(w) AS term FROM t) GROUP BY 1, 2, 3),
    g AS (SELECT count(*) AS n, sum(len(w)) / count(*) AS avgdl FROM t),
    f AS (SELECT term, ln(1 + (any_value(n) - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM p, g GROUP BY 1),
    q AS (SELECT doc_id AS query_id, term, idf FROM p JOIN f USING (term) WHERE doc_id % 20 = 0),
    s AS (SELECT query_id, p.doc_id, round(sum(idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 9) AS score
          FROM q JOIN p USING (term), g GROUP BY 1, 2)
    SELECT query_id, (row_number() OVER w)::INTEGER AS rank, doc_id, score FROM s
    WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, doc_id) QUALIFY row_number() OVER w <= 10""")
def op9(spark: SparkSession, folder: str) -> DataFrame:
    """For every 20th document, as a query of all its words, the 10 best of all documents."""
    return search.search(table(spark, folder, "documents"), F.col("doc_id") % 20 == 0, least=1)


@query("op10_warc", """
    WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
    d AS (SELECT page_id, strlen(html) AS payload_bytes, sha1(html) AS payload_digest FROM p),
    m AS (SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest) END AS top FROM d)
    SELECT page_id, payload_bytes, payload_digest,
           CASE WHEN top IS NOT NULL AND page_id IS DISTINCT FROM top THEN 'revisit' ELSE 'response' END AS record_type,
           CASE WHEN top IS NOT NULL AND page_id IS DISTINCT FROM top THEN top END AS refers_to FROM m""")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    """Every page written as a WARC record and read back."""
    index = warc.write_archives(table(spark, folder, "pages"))
    return warc.read_records(index).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("op11_alignment")
def op11(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's tokens under two tokenizers, grouped where both end."""
    return alignment.align(table(spark, folder, "documents"), tokenizer_file("byte_bpe_50k.json"), tokenizer_file("piece_bpe_32k.model"))


@query("op12_embedding_near_dedup")
def op12(spark: SparkSession, folder: str) -> DataFrame:
    """Every vector with its links and component at cosine 0.95."""
    return forest.near_groups(table(spark, folder, "embeddings"))


#: Nodes level by level up to one a tree; ``{of}`` has (tree, i, h) of the leaves.
TREE_SQL = """
    {name} AS (SELECT 0 AS level, tree, i, h, count(*) OVER (PARTITION BY tree) AS n FROM {of}
               UNION ALL
               SELECT any_value(level) + 1, tree, i // 2, sha256(string_agg(h, '' ORDER BY i)), (any_value(n) + 1) // 2 FROM {name}
               WHERE n > 1 GROUP BY tree, i // 2)"""

#: For each node the way up to its tree's root: the siblings from below, and on which side they are.
WAY_SQL = """
    {name} AS (SELECT a.level, a.tree, a.i, list(struct_pack(left := b.i < u.i, h := b.h) ORDER BY u.level) AS way
               FROM {leaves} a JOIN {nodes} u ON u.tree = a.tree AND u.i = a.i >> u.level AND u.n > 1
               LEFT JOIN {nodes} b ON b.tree = u.tree AND b.level = u.level AND b.i = xor(u.i, 1) GROUP BY ALL)"""


def _crc_sql(text: str) -> str:
    """crc32 in DuckDB, bit by bit: fixed polynomial."""
    step = "list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda s, z: CASE WHEN s & 1 = 1 THEN xor(s >> 1, 3988292384) ELSE s >> 1 END)"
    codes = f"list_transform(string_split({text}, ''), lambda x: ascii(x)::BIGINT)"
    return f"xor(list_reduce(list_concat([4294967295::BIGINT], {codes}), lambda c, b: {step}), 4294967295)"


def _leaf_sql(values: dict[str, str]) -> str:
    return "sha256(" + " || ".join(f"coalesce(strlen({v}::VARCHAR)::VARCHAR || ':' || {v}::VARCHAR, '-')" for v in values.values()) + ")"


_PLAIN = {c: c for c in merkle.FIELDS}

MERKLE_SQL = f"""
    WITH RECURSIVE d AS (SELECT doc_id, coalesce('=' || lang, '') AS tree, {_leaf_sql(_PLAIN)} AS h,
                                CASE WHEN {_crc_sql("doc_id::VARCHAR")} % 7 = 0 THEN {_leaf_sql(_PLAIN | {"n_chars": "(n_chars + 1)"})} END AS shown FROM documents),
    l AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, h) - 1 AS i FROM d),
    {TREE_SQL.format(name="t", of="l")},
    s AS (SELECT '' AS tree, tree AS name, row_number() OVER (ORDER BY tree) - 1 AS i, h FROM t WHERE n = 1),
    {TREE_SQL.format(name="u", of="s")},
    r AS (SELECT h AS root FROM u WHERE n = 1),
    {WAY_SQL.format(name="lw", leaves="(SELECT 0 AS level, tree, i FROM l)", nodes="t")},
    {WAY_SQL.format(name="sw", leaves="(SELECT 0 AS level, tree, i FROM s)", nodes="u")},
    p AS (SELECT doc_id, l.h AS leaf, coalesce(shown, l.h) AS given, s.h AS subroot, root,
                 list_concat(coalesce(lw.way, []), coalesce(sw.way, [])) AS way
          FROM l JOIN s ON s.name = l.tree CROSS JOIN r LEFT JOIN lw ON lw.tree = l.tree AND lw.i = l.i LEFT JOIN sw ON sw.i = s.i),
    f AS (SELECT *, sha256(array_to_string(list_transform(way, lambda x: coalesce(x.h, '')), '')) AS proof_sha256,
                 list_reduce(list_concat([struct_pack("left" := false, h := given)], way),
                             lambda a, x: struct_pack("left" := false, h := sha256(CASE WHEN x."left" THEN x.h || a.h ELSE a.h || coalesce(x.h, '') END))).h AS folded_root FROM p)
    SELECT doc_id, leaf, subroot, root, proof_sha256, folded_root, folded_root = root AS verified FROM f""".replace("struct_pack(left :=", 'struct_pack("left" :=')


@query("op13_merkle_manifest", MERKLE_SQL)
def op13(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's place in the manifest, with every seventh or so tampered with."""
    tampered = F.when(F.col("doc_id").isNotNull() & (remainder("doc_id", 7) == 0), F.col("n_chars") + 1).otherwise(F.col("n_chars"))
    return merkle.manifest(table(spark, folder, "documents"), {"n_chars": tampered})
