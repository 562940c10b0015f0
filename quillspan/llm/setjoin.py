"""All similar pairs between set-valued records by minwise signatures, bands and exact verification.

Records with equal sets form one class; only class representatives are banded, joined and verified. Value sets are
cleaned first (NFC, trimmed, lower case, without leading ``#``, runs of blanks, ``-`` and ``_`` as one blank).

A candidate pair is tested where the bands meet, by an exact bound on the overlap from 64-bit outlines of the two sets,
so that hardly anything but true links leaves the join. Bands with many members are split: two sets can only be similar
if they share one of the rarest values that each of them cannot do without, so the members of such a band meet under
(band, such a value) instead. Neither step loses a link. Tables that grow are never broadcast.

Defined results: of a repeated id the row with the latest time counts (NULL times first; ties: the greater set);
NULL arrays, NULL and blank values are left out; sets below ``min_size`` take no part; a NULL id is a record of its own
id value NULL and is dropped from pairs. Empty tables give empty results. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspan.llm.words import hash64, mix
from quillspan.session import stored

THRESHOLD, MIN_SIZE = 0.6, 3
#: A pair at similarity 0.6 shares no band with probability (1 - 0.6 ** ROWS) ** BANDS, about 1e-4.
ROWS, BANDS = 3, 38
#: Sets in one band from which the band is split by value.
HOT = 256
#: Values whose seeded hashes are computed at a time.
CHUNK = 20_000

_RUN = re.compile(r"[\s\-_]+")


def clean_value(x: str) -> str:
    x = unicodedata.normalize("NFC", x).strip().lower().lstrip("#")
    return _RUN.sub(" ", x).strip()


class Signer:
    """Minwise signatures and outlines of many sets at a time."""

    def __init__(self, rows: int = ROWS, bands: int = BANDS):
        rng = np.random.RandomState(12345)
        self.rows, self.bands = rows, bands
        self.seeds = rng.randint(0, 1 << 62, rows * bands).astype(np.uint64)
        self.power = rng.randint(1, 1 << 31, rows).astype(np.uint64) | np.uint64(1)
        self.salt = rng.randint(0, 1 << 62, bands).astype(np.uint64)

    def bands_of(self, values: np.ndarray, places: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Band hashes [set, band]; set i holds ``values[places[starts[i] : starts[i + 1]]]``, none is empty."""
        out, first = np.empty((len(starts) - 1, self.bands), dtype=np.int64), 0
        while first < len(out):  # as many sets at a time as hold CHUNK values, or a larger one alone
            last = max(first + 1, int(np.searchsorted(starts, starts[first] + CHUNK, "right")) - 1)
            part, cuts = places[starts[first] : starts[last]], starts[first:last] - starts[first]
            if len(part) <= CHUNK:
                low = self._lowest(values, part, cuts)
            else:
                low = np.minimum.reduce([self._lowest(values, part[i : i + CHUNK], cuts[:1]) for i in range(0, len(part), CHUNK)])
            with np.errstate(over="ignore"):
                low = (low.reshape(-1, self.bands, self.rows) * self.power).sum(axis=2, dtype=np.uint64)
            out[first:last] = mix(low ^ self.salt).view(np.int64)
            first = last
        return out

    def _lowest(self, values: np.ndarray, places: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """The least seeded hashes [set, hash] of sets that begin at ``starts`` in ``places``."""
        met, back = np.unique(places, return_inverse=True)
        return np.minimum.reduceat(mix(values[met][:, None] ^ self.seeds[None, :])[back], starts, axis=0)


def outline(hashes: np.ndarray, places: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """64-bit outlines: each value sets one bit. A bit that is set in one outline only stands for at least one value
    that the other set lacks."""
    bits = np.uint64(1) << (hashes >> np.uint64(58))
    return np.bitwise_or.reduceat(bits[places], starts[:-1]).view(np.int64) if len(starts) > 1 else np.empty(0, np.int64)


#: ``f`` is the place of the field in the list of fields.
_SETS = "f int, id bigint, set_key binary, vals array<string>, bits bigint, bands array<bigint>"


def _signed_batch(f: int, ids: list, arrays: list, cleaned: dict, signer: Signer) -> dict:
    kept, values, keys, sets = [], {}, [], []
    places, starts = [], [0]
    for key, raw in zip(ids, arrays):
        if raw is None:
            continue
        vals = set()
        for x in raw:
            if x is not None:
                c = cleaned.get(x)
                if c is None:
                    c = cleaned[x] = clean_value(x)
                vals.add(c)
        vals.discard("")
        if len(vals) >= MIN_SIZE:
            vals = sorted(vals)
            kept.append(key)
            sets.append(vals)
            keys.append(hashlib.blake2b("\x00".join(vals).encode("utf-8", "surrogatepass"), digest_size=16).digest())
            places += [values.setdefault(v, len(values)) for v in vals]
            starts.append(len(places))
    hashes = np.array([hash64(v) for v in values], dtype=np.uint64)
    at, ends = np.array(places, dtype=np.int64), np.array(starts, dtype=np.int64)
    bands = signer.bands_of(hashes ^ mix(np.uint64([f])), at, ends) if kept else np.empty((0, signer.bands), np.int64)
    flat = pa.ListArray.from_arrays(pa.array(np.arange(len(kept) + 1, dtype=np.int32) * signer.bands), pa.array(bands.ravel()))
    return {"f": pa.array([f] * len(kept), pa.int32()), "id": pa.array(kept, pa.int64()), "set_key": pa.array(keys, pa.binary()), "vals": pa.array(sets, pa.list_(pa.string())), "bits": pa.array(outline(hashes, at, ends)), "bands": flat}


def value_sets(df: DataFrame, key: str, fields: list[str], at: str) -> DataFrame:
    """(f, id, set_key, vals, bits, bands) with one row per id and field whose set is large enough."""
    latest = df.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("id")).agg(
        F.max(F.struct(F.coalesce(F.col(at).cast("double"), F.lit(float("-inf"))).alias("at"), *[F.col(f) for f in fields])).alias("r")
    ).select("id", *[F.col(f"r.{f}").alias(f"v{i}") for i, f in enumerate(fields)])

    def sign(batches):
        signer, cleaned = Signer(), {}
        for batch in batches:
            if len(cleaned) > 200_000:
                cleaned.clear()
            ids = batch.column(0).to_pylist()
            for f in range(len(fields)):
                yield pa.RecordBatch.from_pydict(_signed_batch(f, ids, batch.column(f + 1).to_pylist(), cleaned, signer))

    return latest.mapInArrow(sign, _SETS)


def _overlap_fits(threshold: float):
    """SQL condition on rows a and b with (n, bits): their sets may still share enough. What only one outline has bounds
    the shared values from above; both bounds hold for any outline, so no link is lost."""
    shared = F.least(F.col("a.n") - F.bit_count(F.col("a.bits").bitwiseAND(F.bitwise_not("b.bits"))), F.col("b.n") - F.bit_count(F.col("b.bits").bitwiseAND(F.bitwise_not("a.bits"))))
    return shared * (1 + threshold) >= threshold * (F.col("a.n") + F.col("b.n")) - 1e-9


def _meet(keyed: DataFrame, threshold: float) -> DataFrame:
    """Pairs (f, class_a, class_b) of rows (bucket, f, id, n, bits) that meet in a bucket; equal buckets of different
    fields are told apart behind the join, so that its key is one number."""
    a, b = keyed.alias("a"), keyed.hint("merge").alias("b")
    on = (F.col("a.bucket") == F.col("b.bucket")) & (F.col("a.f") - F.col("b.f") == 0) & (F.col("a.id") < F.col("b.id")) & _overlap_fits(threshold)
    return a.join(b, on).select("a.f", F.col("a.id").alias("class_a"), F.col("b.id").alias("class_b"))


def _needed(reps: DataFrame, threshold: float) -> DataFrame:
    """(f, id, value): hashes of the rarest values of each set, as many as a similar set cannot all lack."""
    listed = reps.select("f", "id", "n", F.explode(F.transform("vals", lambda v: F.xxhash64("f", v))).alias("value"))
    counts = listed.groupBy("value").agg(F.count("*").alias("k"))
    ranked = listed.join(counts.hint("merge"), "value").withColumn("place", F.row_number().over(Window.partitionBy("f", "id").orderBy("k", "value")))
    return ranked.where(F.col("place") <= F.col("n") - F.ceil(threshold * F.col("n") - 1e-9) + 1).select("f", "id", "value")


def similar_classes(sets: DataFrame, threshold: float = THRESHOLD, hot: int = HOT) -> tuple[DataFrame, DataFrame]:
    """Members (f, class_id, id) and links between classes (f, class_a, class_b), class_a < class_b; a class is named by
    its smallest id."""
    keys = sets.groupBy("f", "set_key").agg(F.min("id").alias("class_id"))
    members = sets.select("f", "set_key", "id").join(keys.hint("merge"), ["f", "set_key"])
    members = stored(members.select("f", "class_id", "id"), "set-members")
    heads = members.where("id = class_id").select("f", "id")
    reps = sets.join(heads.hint("merge"), ["f", "id"]).select("f", "id", F.size("vals").alias("n"), "vals", "bits", "bands")
    reps = stored(reps, "set-reps")
    banded = reps.select("f", "id", "n", "bits", F.explode("bands").alias("bucket"))
    met = banded.groupBy("bucket").agg(F.count("*").alias("crowd")).where("crowd > 1")
    banded = stored(banded.join(met.hint("shuffle_hash"), "bucket"), "set-bands")
    pairs = _meet(banded.where(F.col("crowd") <= hot), threshold)
    crowded = banded.where(F.col("crowd") > hot)
    if crowded.take(1):
        inside = crowded.select("f", "id").distinct()
        needed = _needed(reps.select("f", "id", "n", "vals").join(inside.hint("merge"), ["f", "id"]), threshold)
        split = crowded.join(needed.hint("merge"), ["f", "id"]).select(F.xxhash64("bucket", "value").alias("bucket"), "f", "id", "n", "bits")
        pairs = pairs.unionByName(_meet(split, threshold))
    pairs = stored(pairs.distinct(), "set-pairs")
    va = reps.select("f", F.col("id").alias("class_a"), F.col("vals").alias("va"))
    vb = reps.select("f", F.col("id").alias("class_b"), F.col("vals").alias("vb"))
    shared = F.size(F.array_intersect("va", "vb"))
    links = (
        va.join(pairs.hint("merge"), ["f", "class_a"]).join(vb.hint("merge"), ["f", "class_b"])
        .where(shared * (1 + threshold) >= threshold * (F.size("va") + F.size("vb")) - 1e-9)
        .select("f", "class_a", "class_b")
    )
    return members, links


def _named(fields) -> F.Column:
    return F.element_at(F.array(*[F.lit(x) for x in fields]), F.col("f") + 1).alias("field_name")


def prepare(df: DataFrame, key: str, fields: list[str], at: str) -> tuple[DataFrame, DataFrame]:
    return similar_classes(stored(value_sets(df, key, fields, at), "set-values"))


def note_pairs(df: DataFrame, key: str = "note_id", fields: tuple[str, ...] = ("tags", "phrases"), at: str = "indexed_at") -> DataFrame:
    """(field_name, note_a, note_b): class links and class memberships written out as pairs of records."""
    members, links = prepare(df, key, list(fields), at)
    ma = members.select("f", F.col("class_id").alias("class_a"), F.col("id").alias("x"))
    mb = members.select("f", F.col("class_id").alias("class_b"), F.col("id").alias("y")).hint("merge")
    same = ma.join(mb.withColumnRenamed("class_b", "class_a"), ["f", "class_a"]).where("x < y")
    across = links.join(ma.hint("merge"), ["f", "class_a"]).join(mb, ["f", "class_b"])
    cols = [_named(fields), F.least("x", "y").alias("note_a"), F.greatest("x", "y").alias("note_b")]
    return same.select(*cols).unionByName(across.select(*cols))


def note_links(df: DataFrame, key: str = "note_id", fields: tuple[str, ...] = ("tags", "phrases"), at: str = "indexed_at") -> DataFrame:
    """(field_name, note_id, class_id, n_links): one row per record and field, however large its class is."""
    members, links = prepare(df, key, list(fields), at)
    size = members.groupBy("f", "class_id").agg(F.count("*").alias("n"))
    links = stored(links, "set-links")
    both = links.select("f", F.col("class_a").alias("class_id"), F.col("class_b").alias("other")).unionByName(
        links.select("f", F.col("class_b").alias("class_id"), F.col("class_a").alias("other"))
    )
    far = (
        both.join(size.hint("merge").select("f", F.col("class_id").alias("other"), "n"), ["f", "other"])
        .groupBy("f", "class_id").agg(F.sum("n").alias("far"))
    )
    return (
        members.join(size.hint("merge"), ["f", "class_id"]).join(far.hint("merge"), ["f", "class_id"], "left")
        .select(_named(fields), F.col("id").alias("note_id"), "class_id", (F.col("n") - 1 + F.coalesce("far", F.lit(0))).alias("n_links"))
    )
