"""Step rules whose next answer depends on their own past.

Each rule is a start state and a step on one record; batch folds and streams share them.
A state is a small JSON value that holds only what the rule can still remember.
"""

import bisect
import math

# Fixed values of the tracking gate and its adaptive floor.
MIN_FITNESS = 0.1
MAX_SPEED_M_S = 1.0
MAX_TURN_DEG_S = 120.0
DT_FALLBACK_S = 0.5
LOST_AFTER = 15
CONFIRM_FRAMES = 3
FITNESS_FRACTION = 0.6
FITNESS_CAP = 0.55
FITNESS_WINDOW = 30
FITNESS_SAMPLES = 5


def missing(x) -> bool:
    return x is None or (isinstance(x, float) and math.isnan(x))


def over(x, limit: float) -> bool:
    """A value that was not measured is over no limit."""
    return not missing(x) and x > limit


class Recent:
    """The last believed fitness values, in arrival order and, beside it, sorted."""

    def __init__(self, values: list[float]):
        self.arrived, self.ranked = values, sorted(values)

    def floor(self) -> float:
        n = len(self.ranked)
        if n < FITNESS_SAMPLES:
            return MIN_FITNESS
        middle = (self.ranked[(n - 1) // 2] + self.ranked[n // 2]) / 2
        return min(max(FITNESS_FRACTION * middle, MIN_FITNESS), FITNESS_CAP)

    def add(self, value: float) -> None:
        if len(self.arrived) == FITNESS_WINDOW:
            self.ranked.pop(bisect.bisect_left(self.ranked, self.arrived.pop(0)))
        self.arrived.append(value)
        bisect.insort(self.ranked, value)


def tracking_fault(row: dict, floor: float, dt: float, jumps: bool = True) -> str | None:
    """Why a tracked frame cannot be believed. What the tracker could not measure is a fault too."""
    if not missing(row.get("error")):
        return "error"
    if missing(row["fitness"]):
        return "no fitness"
    if row["fitness"] < floor:
        return "fitness"
    if jumps and (over(row["step_m"], MAX_SPEED_M_S * dt) or over(row["turn_deg"], MAX_TURN_DEG_S * dt)):
        return "jump"
    return None


def belief_start() -> dict:
    """``phase`` is tracking, lost or probing; ``count`` its faults in a row or, probing, its agreeing frames."""
    return {"phase": "tracking", "count": 0, "recent": []}


def belief_step(dt: float = DT_FALLBACK_S, lost_after: int = LOST_AFTER, confirm: int = CONFIRM_FRAMES):
    """-> step(state, row): may this frame be integrated, is it a candidate, or is it dropped?

    Tracking turns lost after ``lost_after`` faults in a row. From lost, the first frame without a
    fault, whose jump is excused, starts probing; ``confirm`` of them in a row are tracking again,
    and a fault before that is lost again."""
    def step(s: dict, row: dict) -> dict:
        recent = Recent(s["recent"])
        why = tracking_fault(row, recent.floor(), dt, jumps=s["phase"] != "lost")
        if s["phase"] == "tracking":
            s["count"] = s["count"] + 1 if why else 0
            if s["count"] >= lost_after:
                s["phase"], s["count"] = "lost", 0
            back = False
        else:
            s["phase"], s["count"] = ("lost", 0) if why else ("probing", s["count"] + 1)
            back = s["count"] >= confirm
            if back:
                s["phase"], s["count"] = "tracking", 0
        if why:
            verb = "drop"
        elif s["phase"] == "tracking":
            verb = "integrate"
            recent.add(float(row["fitness"]))
        else:
            verb = "confirm"
        return {"verb": verb, "why": why, "lost": s["phase"] != "tracking", "reacquired": int(back)}
    return step


BELIEF_OUT = "verb string, why string, lost boolean, reacquired int"


def gravity_start() -> dict:
    return {"held": None}


def gravity_step(tol: float = 0.08, ema_up: float = 0.25, ema_mag: float = 0.02):
    """-> step(state, row): exponential means of direction and magnitude, over the samples whose
    magnitude is within ``tol`` of its mean. The first sample that is not zero starts both."""
    keep = (1 - ema_up, 1 - ema_up, 1 - ema_up, 1 - ema_mag)
    take = (ema_up, ema_up, ema_up, ema_mag)

    def step(s: dict, row: dict) -> dict:
        sample = [row["x"], row["y"], row["z"]]
        known = not any(missing(a) for a in sample)
        if known:
            sample.append(math.sqrt(sample[0] * sample[0] + sample[1] * sample[1] + sample[2] * sample[2]))
        held = s["held"]
        used = known and sample[3] >= 1e-3 and (held is None or abs(sample[3] - held[3]) <= tol * held[3])
        if used:
            s["held"] = held = sample if held is None else [k * a + t * b for k, a, t, b in zip(keep, held, take, sample)]
        ux, uy, uz = held[:3] if held else (None, None, None)
        return {"ux": ux, "uy": uy, "uz": uz, "used": used}
    return step


GRAVITY_OUT = "ux double, uy double, uz double, used boolean"


def height_start() -> dict:
    return {"value": None}


def height_step(gain: float = 0.02):
    """-> step(state, row): the best height so far moves only when beaten by ``gain``."""
    def step(s: dict, row: dict) -> dict:
        h = row["height"]
        took = not missing(h) and (s["value"] is None or h > s["value"] + gain)
        if took:
            s["value"] = float(h)
        return {"value": s["value"], "took": took}
    return step


def settle_start() -> dict:
    return {"settled": False, "n": 0, "prev": None, "run": 0, "capped": False}


def settle_step(drift: float = 8e-4, hold: int = 8, cap: int = 150):
    """-> step(state, row): has the white balance stopped moving?"""
    def step(s: dict, row: dict) -> dict:
        if s["settled"]:
            return {"settled": True, "capped": s["capped"]}
        s["n"] += 1
        m = (row["r"], row["g"], row["b"])
        if any(missing(x) for x in m) or sum(m) <= 0:
            return {"settled": False, "capped": False}
        c = [x / sum(m) for x in m]
        if s["prev"] is not None:
            s["run"] = s["run"] + 1 if max(abs(a - b) for a, b in zip(c, s["prev"])) < drift else 0
        s["prev"] = c
        if s["run"] >= hold:
            s["settled"] = True
        elif s["n"] >= cap:
            s["settled"] = s["capped"] = True
        return {"settled": s["settled"], "capped": s["capped"]}
    return step
