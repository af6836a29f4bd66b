"""Frame classification: a chain of rules, each on what the former ones left.

The order of the rules is part of the meaning: a rule leaves frames alone that
are anomalous already, but for the first-frame rule, which overwrites. Rules
that look sequential are closed forms over windows (see ``tail_extension``).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from framestride.functions.columns import flag
from framestride.operators.sequence import along

# The limits of the rules, and the classes and reasons that results carry.
UNIFORM_FRACTION = 0.70
MIN_CONTRAST = 8
MIN_ENTROPY = 3
BLOCK_ENTROPY = 6
STABLE_HS = 0.18
STABLE_INTENSITY = 0.12
STABILITY_WINDOW = 3
MAX_EXTENSION = 4
MIN_MATCHES = 20
MIN_INLIERS = 0.35
ZOOM_CHANGE = 0.04
VALID, TRANSITION, ZOOM, SCENE_CHANGE = "valido", "transicion", "zoom", "cambio_escena"
WHITE, BLACK, UNIFORM, STRIPES, BLOCKS = "fondo_blanco", "fondo_negro", "frame_uniforme", "artefactos_franjas", "artefactos_bloques"
CONTINUITY, START, BOTH_SIDES, SATURATION = "continuidad", "inicio_atipico", "difiere_del_anterior_y_del_siguiente", "cambio_inestable_de_saturacion"
TAIL, BETWEEN, SCALE, REFRAMING = "cola_transicion_inestable", "entre_frames_anomalos", "cambio_escala_%.3f", "cambio_persistente_de_encuadre"


#: Rows before and after a stretch that the whole chain looks at.
HALO = 12


@dataclass(frozen=True)
class Columns:
    """Names of the columns that the rules read.

    No rule looks further than a few rows, so over ``ordered.stretched`` rows (with ``HALO``)
    the key is the sequence and the stretch, and ``total`` the length of the sequence.
    """

    key: str | list[str] = "video"
    index: str = "idx"
    total: str | None = None


def own_reasons(stripes_limit: Column, vertical_limit: Column, blocks_limit: Column) -> Column:
    """Reasons of a frame by itself, joined by ``;`` in a fixed order; empty without any."""
    uniform = flag(F.col("contrast") <= MIN_CONTRAST) | flag(F.col("entropy") <= MIN_ENTROPY)
    stripes = flag(F.col("stripes_h") >= stripes_limit) | flag(F.col("stripes_v") >= vertical_limit)
    return F.concat_ws(
        ";", F.when(F.col("white") >= UNIFORM_FRACTION, WHITE), F.when(F.col("black") >= UNIFORM_FRACTION, BLACK), F.when(uniform, UNIFORM),
        F.when(stripes, STRIPES), F.when((F.col("blocks") >= blocks_limit) & (F.col("entropy") < BLOCK_ENTROPY), BLOCKS))


def start(df: DataFrame, own: Column) -> DataFrame:
    """Adds ``anomaly, class, reason`` from a column of own reasons."""
    bad = own != ""
    return df.withColumn("_own", own).withColumns({
        "anomaly": flag(F.col("_own") != ""), "class": F.when(bad, TRANSITION).otherwise(VALID), "reason": F.when(bad, F.col("_own")).otherwise(CONTINUITY)}).drop("_own")


def mark(df: DataFrame, where: Column, reason: Column | str, kind: str = TRANSITION) -> DataFrame:
    """Make the rows of a condition anomalous. The condition is evaluated once, before any of them changes."""
    text = F.lit(reason) if isinstance(reason, str) else reason
    return df.withColumn("_hit", flag(where)).withColumns({
        "anomaly": F.col("anomaly") | F.col("_hit"), "class": F.when(F.col("_hit"), kind).otherwise(F.col("class")), "reason": F.when(F.col("_hit"), text).otherwise(F.col("reason"))}).drop("_hit")


def first_frame(df: DataFrame, hs: Column, intensity: Column, c: Columns = Columns()) -> DataFrame:
    """The first frame, if it changes to the second and that goes on calmly. Overwrites other reasons."""
    w = along(c.key, c.index)
    change = flag(F.col("hs_next") >= hs) | flag(F.col("di_next") >= intensity)
    calm = flag(F.lead("hs_next").over(w) <= STABLE_HS) & flag(F.lead("di_next").over(w) <= STABLE_INTENSITY)
    return mark(df, (F.col(c.index) == 0) & change & calm, START)


def two_sided(df: DataFrame, hs: Column, intensity: Column, saturation: Column, c: Columns = Columns()) -> DataFrame:
    """Inner frames that differ from both neighbours, or whose saturation jumps on both sides."""
    w = along(c.key, c.index)
    inner = (F.col(c.index) > 0) & F.lead(F.lit(True)).over(w) & ~F.col("anomaly")
    before = flag(F.col("hs") >= hs) | flag(F.col("di") >= intensity)
    after = flag(F.col("hs_next") >= hs) | flag(F.col("di_next") >= intensity)
    jumps = flag(F.col("sat") >= saturation) & flag(F.col("sat_next") >= saturation)
    out = df.withColumn("_inner", flag(inner))
    return mark(out, F.col("_inner") & ((before & after) | jumps), F.when(before & after, BOTH_SIDES).otherwise(SATURATION)).drop("_inner")


def tail_extension(df: DataFrame, c: Columns = Columns()) -> DataFrame:
    """Frames after an anomaly, up to a stable stretch and at most ``MAX_EXTENSION``.

    Closed form: with s the last anomaly before a frame r and t the last frame up
    to r that begins a stable stretch, r is marked if r - s is small enough, r is
    not among the last frames and t isn't after s.
    """
    w = along(c.key, c.index)
    ahead = w.rowsBetween(0, STABILITY_WINDOW)
    calm = flag(F.col("hs_next") <= STABLE_HS) & flag(F.col("di_next") <= STABLE_INTENSITY)
    own = df.withColumns({"_calm": calm, "_n": F.col(c.total) if c.total else F.count(F.lit(1)).over(W.partitionBy(*([c.key] if isinstance(c.key, str) else c.key)))})
    near = w.rowsBetween(0, STABILITY_WINDOW - 1)
    stable = ~F.max("anomaly").over(ahead) & F.min("_calm").over(near) & (F.col(c.index) + STABILITY_WINDOW < F.col("_n"))
    own = own.withColumn("_stable", stable)
    # an anomaly further back than MAX_EXTENSION marks nothing, so what a stretch can't see doesn't matter
    past = w.rowsBetween(W.unboundedPreceding, -1)
    own = own.withColumns({
        "_s": F.max(F.when(F.col("anomaly"), F.col(c.index))).over(past),
        "_t": F.max(F.when(F.col("_stable"), F.col(c.index))).over(w.rowsBetween(W.unboundedPreceding, 0))})
    where = (~F.col("anomaly") & (F.col(c.index) - F.col("_s") <= MAX_EXTENSION) & (F.col(c.index) <= F.col("_n") - STABILITY_WINDOW - 1)
             & (F.col("_t").isNull() | (F.col("_t") < F.col("_s"))))
    return mark(own, where, TAIL).drop("_calm", "_n", "_stable", "_s", "_t")


def gap_fill(df: DataFrame, c: Columns = Columns()) -> DataFrame:
    """A valid frame between two anomalies."""
    w = along(c.key, c.index)
    return mark(df, ~F.col("anomaly") & F.lag("anomaly").over(w) & F.lead("anomaly").over(w), BETWEEN)


def zoom(df: DataFrame, c: Columns = Columns()) -> DataFrame:
    """A fast change of scale whose geometry holds together; never the first frame."""
    where = ((F.col(c.index) > 0) & ~F.col("anomaly") & (F.col("matches") >= MIN_MATCHES) & (F.col("inliers") >= MIN_INLIERS)
             & F.col("scale").isNotNull() & (F.abs(F.ln("scale")) >= ZOOM_CHANGE))
    return mark(df, where, F.format_string(SCALE, "scale"), ZOOM)


def classify(df: DataFrame, limits: DataFrame | None = None, c: Columns = Columns()) -> DataFrame:
    """The whole chain. ``limits`` has one row for each key with ``<column>_limit`` columns; without it the rows have these."""
    lim = {x: F.col(f"{x}_limit") for x in ("hs", "di", "sat", "stripes_h", "stripes_v", "blocks")}
    w = along(c.key, c.index)
    out = (df if limits is None else df.join(limits, c.key)).withColumns({f"{x}_next": F.lead(x).over(w) for x in ("hs", "di", "sat")})
    out = start(out, own_reasons(lim["stripes_h"], lim["stripes_v"], lim["blocks"]))
    out = first_frame(out, lim["hs"], lim["di"], c)
    out = two_sided(out, lim["hs"], lim["di"], lim["sat"], c)
    out = gap_fill(tail_extension(out, c), c)
    return gap_fill(zoom(out, c), c)
