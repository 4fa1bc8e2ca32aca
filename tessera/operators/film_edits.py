"""Corrections of a day's tracks: cuts, joins, false tracks, kinds of people and marks, as a log of edits beside the tracks.

Edits name the fingerprint of the track that they were made against. Where the track has been computed anew, its edits stop
counting and the track is reported as stale; they are not deleted. Parts, people and marks are derived in joins and windows.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .graph import components
from .greedy import per_group
from .scratch import cut

#: A cut less than this after a part begins gives the whole part away instead.
START = 1.0
#: A mark within so many seconds (and pixels) of one of its kind takes it back.
NEAR_S, NEAR_X, NEAR_Y = 1.5, 100, 160


def stale_tracks(tracks: DataFrame, edits: DataFrame) -> DataFrame:
    """(day, track) with edits against another fingerprint than the track has now."""
    return edits.where("print is not null").select("day", "track", "print").distinct().join(tracks.select("day", "track", "fp"), ["day", "track"]).where("print <> fp").select("day", "track").distinct()


def live_edits(tracks: DataFrame, edits: DataFrame, stale: DataFrame | None = None) -> DataFrame:
    """The edits that count: of known tracks that aren't stale (marks of missed people name no track), and not undone.

    An undo takes back the last edit before it, once; an undo after an undo finds nothing.
    """
    stale = stale_tracks(tracks, edits) if stale is None else stale
    w = Window.partitionBy("day").orderBy("seq")  # a day's edits, made by hand
    told = edits.withColumn("_next", F.lead("action").over(w)).where("action <> 'undo' and coalesce(_next, '') <> 'undo'").drop("_next")
    known = told.join(tracks.select("day", "track", F.lit(True).alias("_known")), ["day", "track"], "left").where("_known or track is null").drop("_known")
    return known.join(stale, ["day", "track"], "left_anti")


def parts(tracks: DataFrame, live: DataFrame) -> DataFrame:
    """(day, track, part, first, last, detached) after the cuts; a part is named by its beginning, the first by nothing.

    ``tracks``: (day, track, first, last, fp). A cut within START of the beginning of a part only detaches that part, as do all
    other cuts with the part that they begin; cuts outside a track are ignored.
    """
    cuts = live.where("action = 'split'").select("day", "track", F.round("at", 2).alias("at")).distinct()
    inside = cuts.join(tracks.select("day", "track", F.col("first").alias("_f"), F.col("last").alias("_l")), ["day", "track"]).where("at < _l")
    w = Window.partitionBy("day", "track").orderBy("at")
    inside = inside.withColumn("_from", F.coalesce(F.lag("at").over(w), F.col("_f"))).withColumn("whole", F.col("at") - F.col("_from") < START)
    starts = inside.where("not whole").select("day", "track", "at")
    begins = tracks.select("day", "track", F.lit(None).cast("double").alias("at"), F.col("first").alias("from")).unionByName(starts.select("day", "track", "at", F.col("at").alias("from")))
    begins = begins.withColumn("until", F.lead("from").over(Window.partitionBy("day", "track").orderBy("from")))
    away = inside.where("whole").select("day", "track", F.col("_from").alias("from"), F.lit(True).alias("gone")).distinct()
    out = begins.join(tracks.select("day", "track", "last"), ["day", "track"]).join(away, ["day", "track", "from"], "left")
    return out.select("day", "track", F.when(F.col("at").isNull(), F.concat("track", F.lit("@"))).otherwise(F.format_string("%s@%.2f", "track", "at")).alias("part"), F.col("from").alias("first"), F.coalesce("until", "last").alias("last"), (F.col("at").isNotNull() | F.coalesce("gone", F.lit(False))).alias("detached"))


def _toggled(live: DataFrame) -> DataFrame:
    """(day, part) marked false an odd number of times since it was last joined to somebody."""
    joined = live.where("action = 'same'").select("day", "seq", F.explode(F.array("part", "target")).alias("part")).groupBy("day", "part").agg(F.max("seq").alias("_joined"))
    marks = live.where("action = 'false'").join(joined, ["day", "part"], "left").where("_joined is null or seq > _joined")
    return marks.groupBy("day", "part").agg(F.count("*").alias("n")).where("n % 2 = 1").select("day", "part")


def marks(live: DataFrame) -> DataFrame:
    """(day, kind, place, at, x, y): the marks that stand. ``live``: (day, seq, action, part, at, x, y); ``part`` is a part, for missed people a camera.

    A mark within NEAR_S seconds (of missed people NEAR_X and NEAR_Y pixels, too) of standing ones of its place takes them back
    instead. A place's few marks are walked in order.
    """

    def walk(f: pd.DataFrame) -> pd.DataFrame:
        stand: list[tuple] = []
        for at, x, y in zip(f["at"], f["x"], f["y"], strict=True):
            near = [m for m in stand if abs(m[0] - at) < NEAR_S and (pd.isna(x) or (abs(m[1] - x) < NEAR_X and abs(m[2] - y) < NEAR_Y))]
            stand = [m for m in stand if m not in near] if near else [*stand, (at, x, y)]
        return pd.DataFrame([(f["day"].iloc[0], f["kind"].iloc[0], f["place"].iloc[0], *m) for m in stand], columns=["day", "kind", "place", "at", "x", "y"])

    rows = live.where("action in ('badmask', 'missed')").select("day", F.col("action").alias("kind"), F.col("part").alias("place"), "seq", "at", "x", "y")
    return per_group(rows, ["day", "kind", "place"], ["seq"], walk, f"day {live.schema['day'].dataType.simpleString()}, kind string, place string, at double, x double, y double")


def people(tracks: DataFrame, links: DataFrame, edits: DataFrame) -> DataFrame:
    """(day, track, part, first, last, person, kind, false, stale) of a day's parts.

    ``links``: (day, a, b), tracks that the machine holds for one person, the end of a going on in b. A part goes on in the next of
    its track and over a link, unless the part that it would go on in is detached; "same" joins any two parts. A false part is
    nobody. A person is named by the smallest of their parts; the last word on the kind of any of a person's parts holds
    (else: customer).
    """
    tracks, edits = cut(tracks, "film-tracks"), cut(edits, "film-edits")  # each is read many times
    stale = cut(stale_tracks(tracks, edits), "film-stale")
    live = cut(live_edits(tracks, edits, stale), "film-live")
    own = cut(parts(tracks, live), "film-parts")
    false = cut(_toggled(live).withColumn("false", F.lit(True)), "film-false")
    real = own.join(false.select("day", "part"), ["day", "part"], "left_anti")
    w = Window.partitionBy("day", "track").orderBy("first")
    walked = real.select("*", F.lead("part").over(w).alias("next"), F.lead("detached").over(w).alias("away"), F.row_number().over(w).alias("k"))
    walked = cut(walked, "film-walked")
    onward = walked.where("not away").select("day", F.col("part").alias("a"), F.col("next").alias("b"))
    ends = walked.where("next is null").select("day", F.col("track").alias("a"), F.col("part").alias("pa"))
    heads = walked.where("k = 1 and not detached").select("day", F.col("track").alias("b"), F.col("part").alias("pb"))
    linked = links.join(ends, ["day", "a"]).join(heads, ["day", "b"]).select("day", F.col("pa").alias("a"), F.col("pb").alias("b"))
    said = live.where("action = 'same'").select("day", F.col("part").alias("a"), F.col("target").alias("b"))
    name = lambda c: F.concat_ws("|", F.col("day").cast("string"), F.col(c))
    pairs = onward.unionByName(linked).unionByName(said)
    roots = cut(components(pairs.select(name("a").alias("a"), name("b").alias("b"))), "film-roots")
    out = own.withColumn("node", name("part")).join(roots, "node", "left").join(false, ["day", "part"], "left").join(stale.withColumn("stale", F.lit(True)), ["day", "track"], "left")
    out = cut(out.withColumn("person", F.when(F.col("false").isNull(), F.coalesce("root", "node"))), "film-out")
    kinds = live.where("action = 'kind'").join(out.where("person is not null").select("day", "part", "person"), ["day", "part"]).groupBy("person").agg(F.max_by("kind", "seq").alias("kind"))
    no = F.lit(False)
    return out.join(kinds, "person", "left").select(
        "day", "track", "part", "first", "last", "person", F.when(F.col("person").isNotNull(), F.coalesce("kind", F.lit("customer"))).alias("kind"), F.coalesce("false", no).alias("false"), F.coalesce("stale", no).alias("stale")
    )
