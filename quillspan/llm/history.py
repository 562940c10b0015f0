"""Batches against everything accepted before: multi-key sorted-neighbourhood runs.

Each text has KEYS sort keys, each made of KEY_HASHES minwise hashes of its runs of three words, so near-identical
texts stand side by side under at least one key. The history is a folder of sorted runs: keys (key, size, file), sets of
word runs by file and content hashes. A run is cut into ranges of its order, one file each, with about as many rows, and
the index of the history holds the first and the last value of each range. A delivery reads only the ranges that its own
keys, hashes and met files fall into, merges its sorted keys with them and compares the windows around its records: those
of equal key whose set size and sketch lie within the threshold's reach. Every pair met is verified exactly. Runs have levels; when
a level holds more than MAX_RUNS they are merged into one of the next level, so a row is rewritten once a level.

A history is opened again by its folder: the index is one file, written under a new number after all it names.

Copies of one text form a class that is represented by its smallest id; only representatives enter windows.

Defined results: of a repeated id one row counts (the greatest content hash); a NULL id is dropped; a NULL content is
accepted and matches nothing; texts under three words match by hash only; an empty delivery or history is allowed.
Extra columns are ignored. Ties do not occur, as ids are unique.
"""

from __future__ import annotations

import json
import math
import uuid

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspan.llm.words import WordHashes, mix, runs, words
from quillspan.plans.leaders import leaders
from quillspan.session import scratch_table, stored

THRESHOLD, RUN_WORDS = 0.7, 3
#: A pair at similarity 0.7 meets under no key with probability (1 - 0.7 ** 3) ** 24, about 4e-5.
KEYS, KEY_HASHES = 24, 3
#: Bits of a sketch, one of each of as many minwise hashes, and deviations above the mean up to which pairs at the
#: threshold may differ in them: more with probability 2e-7.
BITS, DEVIATIONS = 128, 5.2
#: Runs of one level that may pile up before they are merged.
MAX_RUNS = 7
#: Of each kind of run: the columns, the one that it is sorted by, and the rows of a range, about.
KINDS = {
    "keys": ("key bigint, n int, file_id bigint, s1 bigint, s2 bigint", "key", 500_000),
    "sets": ("file_id bigint, runs array<bigint>", "file_id", 20_000),
    "hashes": ("content_sha string, file_id bigint", "content_sha", 500_000),
}

_SIGNED = "file_id bigint, content_sha string, n int, runs array<bigint>, keys array<bigint>, s1 bigint, s2 bigint"


def classes(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Members (file_id, content_sha, rep) and the contents (file_id, content_sha, content) of the representatives of
    (file_id, content). Ids and hashes travel alone; a content is shuffled once, copies are merged on the way."""
    hashed = files.where("file_id IS NOT NULL").select("file_id", "content", F.sha2(F.col("content").cast("binary"), 256).alias("content_sha"))
    ids = hashed.groupBy("file_id").agg(F.max("content_sha").alias("content_sha"))
    firsts = ids.where("content_sha IS NOT NULL").groupBy("content_sha").agg(F.min("file_id").alias("rep"))
    texts = hashed.where("content_sha IS NOT NULL").groupBy("content_sha").agg(F.first("content").alias("content"))
    reps = texts.join(firsts, "content_sha").select(F.col("rep").alias("file_id"), "content_sha", "content")
    return ids.where("content_sha IS NOT NULL").join(firsts, "content_sha"), reps


def sign(reps: DataFrame, run_words: int = RUN_WORDS) -> DataFrame:
    """(file_id, content_sha, n, runs, keys, s1, s2) of (file_id, content_sha, content); the sketch is s1 and s2."""
    rng = np.random.RandomState(20240229)
    seeds = rng.randint(0, 1 << 62, BITS).astype(np.uint64)[:, None]
    factors = (rng.randint(0, 1 << 62, BITS).astype(np.uint64) | np.uint64(1))[:, None]
    salts = rng.randint(0, 1 << 62, KEYS).astype(np.uint64)
    odd = np.arange(1, 2 * KEY_HASHES, 2, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)

    def go(batches):
        store = WordHashes()
        for pdf in batches:
            rs, ks, sketch = [], [], np.zeros((len(pdf), 2), np.int64)
            for i, text in enumerate(pdf.content):
                r = np.unique(runs(store.of(words(text)), run_words)) if text is not None else ()
                if not len(r):
                    rs.append([]), ks.append([])
                    continue
                # run hashes are mixed already: a seeded xor and an odd factor order them anew
                low = np.minimum.reduce([((r[None, at : at + 2048] ^ seeds) * factors).min(axis=1) for at in range(0, len(r), 2048)])
                with np.errstate(over="ignore"):
                    ks.append(mix((low[: KEYS * KEY_HASHES].reshape(KEYS, KEY_HASHES) * odd).sum(axis=1, dtype=np.uint64) ^ salts).view(np.int64))
                sketch[i] = np.packbits(((mix(low) >> np.uint64(17)) & np.uint64(1)).astype(bool)).view(np.int64)
                rs.append(r.view(np.int64))
            yield pd.DataFrame({"file_id": pdf.file_id, "content_sha": pdf.content_sha, "n": [len(r) for r in rs], "runs": pd.Series(rs, dtype=object, index=pdf.index), "keys": pd.Series(ks, dtype=object, index=pdf.index), "s1": sketch[:, 0], "s2": sketch[:, 1]})

    return reps.mapInPandas(go, _SIGNED)


def apart_at(threshold: float) -> int:
    """Bits in which sketches of texts at the threshold may differ: each bit does with half the dissimilarity."""
    p = (1 - threshold) / 2
    return math.ceil(BITS * p + DEVIATIONS * math.sqrt(BITS * p * (1 - p)))


def clean_sha(c):
    """A reported hash in plain form: lower case, no blanks, no ``sha256:`` in front."""
    return F.regexp_replace(F.lower(F.trim(c)), "^sha-?256:", "")


def _keyed(signed: DataFrame) -> DataFrame:
    return signed.select(F.explode("keys").alias("key"), "n", "file_id", "s1", "s2")


class History:
    """Everything accepted so far, as sorted runs in a folder that all executors share."""

    def __init__(self, spark: SparkSession, folder: str | None = None):
        self.spark = spark
        self.folder = folder or scratch_table(spark, "history")
        self.version, self.runs = 0, []  # of each run: kind, level, path, ranges (file, first, last, rows)
        self.last_read: dict[str, tuple[int, int]] = {}  # ranges read and held, by kind, of the last delivery
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        at = self._path(f"{self.folder}/index")
        if self._fs.exists(at):
            self.version = max((int(f.getPath().getName()) for f in self._fs.listStatus(at) if f.getPath().getName().isdigit()), default=0)
            if self.version:
                self.runs = json.loads("".join(r.value for r in spark.read.text(f"{self.folder}/index/{self.version}").collect()))  # one line of a bounded size

    def _save(self) -> None:
        """Writes the index under the next number: first aside, then by renaming, so that no reader sees a part of it."""
        self.version += 1
        aside = self._path(f"{self.folder}/index/part-{uuid.uuid4().hex}")
        out = self._fs.create(aside)
        out.write(bytearray(json.dumps(self.runs).encode()))
        out.close()
        self._fs.rename(aside, self._path(f"{self.folder}/index/{self.version}"))
        self._fs.delete(self._path(f"{self.folder}/index/{self.version - 2}"), False)

    def drop(self) -> None:
        """Deletes the folder of the history."""
        self._fs.delete(self._path(self.folder), True)

    def _write(self, kind: str, df: DataFrame, level: int) -> None:
        """One sorted run of ``df``, which must be cheap to read twice; a range is a file."""
        schema, order, per_range = KINDS[kind]
        path = f"{self.folder}/{kind}-{level}-{uuid.uuid4().hex[:12]}"
        names = [c.split()[0] for c in schema.split(", ")]
        rows = df.select(*names)
        n = -(-rows.count() // per_range)
        if not n:
            return
        by = [order, *[c for c in names if c in ("n", "file_id") and c != order]]
        rows = rows.repartitionByRange(n, *by) if n > 1 else rows.repartition(1)
        rows.sortWithinPartitions(*by).write.parquet(path)
        ranges = self.spark.read.schema(schema).parquet(path).groupBy(F.input_file_name().alias("file")).agg(
            F.min(order).alias("first"), F.max(order).alias("last"), F.count("*").alias("n")
        ).collect()  # one row a file
        self.runs.append({"kind": kind, "level": level, "path": path, "ranges": sorted([r.file, r.first, r.last, r.n] for r in ranges)})

    def _read(self, kind: str, wanted: DataFrame | None) -> DataFrame:
        """The rows of ``kind`` in the ranges that hold any value of the one column of ``wanted`` (None: all ranges)."""
        schema = KINDS[kind][0]
        ranges = [r for run in self.runs if run["kind"] == kind for r in run["ranges"]]
        files = [r[0] for r in ranges]
        if wanted is not None and len(ranges) > 1:
            shared = self.spark.sparkContext.broadcast([(r[1], r[2]) for r in ranges])  # two values a range

            def met(batches):
                bounds = shared.value
                open_ = set(range(len(bounds)))
                for pdf in batches:
                    v = np.sort(pdf.iloc[:, 0].dropna().to_numpy())
                    for i in sorted(open_):
                        at = int(np.searchsorted(v, bounds[i][0]))
                        if at < len(v) and v[at] <= bounds[i][1]:
                            open_.discard(i)
                            yield pd.DataFrame({"i": [i]})

            touched = wanted.mapInPandas(met, "i int").distinct().collect()  # at most one row a range
            files = [files[r.i] for r in touched]
        self.last_read[kind] = (len(files), len(ranges))
        return self.spark.read.schema(schema).parquet(*files) if files else self.spark.createDataFrame([], schema)

    def _compact(self) -> None:
        """Merges the runs of a level that holds too many; what they were made of goes once the index names the new run."""
        gone = []
        for kind in KINDS:
            level = 0
            while level <= max((r["level"] for r in self.runs if r["kind"] == kind), default=-1):
                old = [r for r in self.runs if r["kind"] == kind and r["level"] == level]
                if len(old) > MAX_RUNS:
                    self._write(kind, self.spark.read.schema(KINDS[kind][0]).parquet(*[r["path"] for r in old]), level + 1)
                    self.runs = [r for r in self.runs if r not in old]
                    gone += old
                level += 1
        self._save()
        for r in gone:
            self._fs.delete(self._path(r["path"]), True)

    def accept_hashes(self, known: DataFrame) -> None:
        """(file_id, content_sha) of accepted files whose content need not be at hand."""
        known = known.where("file_id IS NOT NULL AND content_sha IS NOT NULL").groupBy("content_sha").agg(F.min("file_id").alias("file_id"))
        self._write("hashes", stored(known, "history-known"), 0)
        self._compact()

    def _append(self, reps: DataFrame, keyed: DataFrame) -> None:
        self._write("hashes", reps.select("content_sha", "file_id"), 0)
        self._write("sets", reps.where("n > 0").select("file_id", "runs"), 0)
        self._write("keys", keyed, 0)
        self._compact()

    def accept(self, files: DataFrame) -> None:
        """Takes all of ``files`` (file_id, content) in without checks."""
        reps = stored(sign(classes(files)[1]), "history-signed")
        self._append(reps, stored(_keyed(reps), "history-keyed"))

    def ingest(self, files: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
        """The cases (earlier_file_id, file_id) of a delivery (file_id, content), taken in the order of ids;
        the rest of the delivery is accepted."""
        members, texts = classes(files)
        members = stored(members, "history-members")
        reps = stored(sign(texts), "history-signed")
        keyed = stored(_keyed(reps), "history-keyed")  # a known size: the planner cannot see what explode multiplies
        known = self._read("hashes", reps.select("content_sha")).groupBy("content_sha").agg(F.min("file_id").alias("earlier"))
        exact = reps.select("file_id", "content_sha").join(known, "content_sha").select("file_id", "earlier", F.lit(True).alias("old"))

        apart = F.bit_count(F.col("s1").bitwiseXOR(F.col("t1"))) + F.bit_count(F.col("s2").bitwiseXOR(F.col("t2")))
        window = (F.col("m") >= threshold * F.col("n")) & (F.col("n") >= threshold * F.col("m")) & (apart <= apart_at(threshold))
        theirs = ["key", F.col("n").alias("m"), F.col("file_id").alias("earlier"), F.col("s1").alias("t1"), F.col("s2").alias("t2")]
        before = keyed.join(self._read("keys", keyed.select("key")).select(*theirs), "key").where(window & (F.col("earlier") != F.col("file_id")))
        beside = keyed.join(keyed.select(*theirs).hint("merge"), "key").where(window & (F.col("earlier") < F.col("file_id")))
        met = before.select("file_id", "earlier", F.lit(True).alias("old")).unionByName(beside.select("file_id", "earlier", F.lit(False).alias("old")))
        met = stored(met.distinct(), "history-met")  # pairs are few; a known size lets the planner leave the sets where they lie
        # only sets that are needed travel: the ids of a side are narrow, and where they are few the planner sends them instead
        wanted = stored(met.select("earlier").distinct(), "history-wanted")
        own = reps.select(F.col("file_id").alias("earlier"), F.col("runs").alias("b")).join(wanted, "earlier", "left_semi")
        sets = self._read("sets", wanted).select(F.col("file_id").alias("earlier"), F.col("runs").alias("b")).join(wanted, "earlier", "left_semi")
        both = met.where("old").join(sets, "earlier").unionByName(met.where("NOT old").join(own, "earlier"))
        mine = stored(met.select("file_id").distinct(), "history-mine")
        ours = reps.select("file_id", F.col("runs").alias("a")).join(mine, "file_id", "left_semi")
        shared = F.size(F.array_intersect("a", "b"))
        near = (
            both.join(ours, "file_id")
            .where(shared >= threshold * (F.size("a") + F.size("b") - shared)).select("file_id", "earlier", "old")
        )
        edges = exact.unionByName(near).select(F.col("file_id").alias("item"), "earlier", "old")
        decided = leaders(edges, []).select(F.col("item").alias("file_id"), F.col("leader").alias("earlier"))

        dropped = decided.where("earlier IS NOT NULL")
        kept = reps.join(dropped.select("file_id"), "file_id", "left_anti")
        self._append(kept, keyed.join(dropped.select("file_id"), "file_id", "left_anti"))
        cases = (
            members.join(dropped.select(F.col("file_id").alias("rep"), "earlier"), "rep", "left")
            .withColumn("earlier_file_id", F.when(F.col("earlier").isNotNull(), F.col("earlier")).when(F.col("file_id") != F.col("rep"), F.col("rep")))
            .where("earlier_file_id IS NOT NULL").select("earlier_file_id", "file_id")
        )
        return stored(cases, "history-cases")


def repeated_files(input_files: DataFrame, manifest: DataFrame, batches_per_delivery: int = 8) -> DataFrame:
    """(earlier_file_id, file_id): batch 0 and the manifest are the history; later batches come in deliveries."""
    spark = input_files.sparkSession
    history = History(spark)
    entries = manifest.select(F.explode("processed").alias("e")).where("e IS NOT NULL")
    history.accept_hashes(entries.select(F.col("e.file_id").cast("bigint").alias("file_id"), clean_sha(F.col("e.sha256")).alias("content_sha")))
    history.accept(input_files.where("batch_no = 0 OR batch_no IS NULL").select("file_id", "content"))
    top = input_files.agg(F.max("batch_no")).first()[0] or 0
    cases = None
    for first in range(1, top + 1, batches_per_delivery):
        part = input_files.where(F.col("batch_no").between(first, first + batches_per_delivery - 1))
        found = history.ingest(part.select("file_id", "content"))
        cases = found if cases is None else cases.unionByName(found)
    history.drop()
    return cases if cases is not None else spark.createDataFrame([], "earlier_file_id bigint, file_id bigint")
