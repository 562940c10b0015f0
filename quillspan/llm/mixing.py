"""Sources mixed to target weights by soft membership.

A classifier (multinomial naive Bayes over hashed token ids) is trained on a bounded sample of labelled documents. On the
held-out part of the sample two numbers are fitted by likelihood: a temperature, as words of a text are not independent,
and the share of wrong labels. A document's membership in the wanted sources is its posterior given text and label; where
labels are mostly right and texts tell little it stays near the label, where texts are plain it corrects wrong labels.
Document rates (how often a document is taken, 0 to the cap of its source) then solve a nonnegative least squares problem:
the expected token totals of the sources match their target shares of the total. Of all rates that do so equally well the
ones nearest to 1 are taken (a penalty of weight ``PENALTY``); these follow from one price per source, which is found by
Newton steps over all documents, pre-aggregated by label and rounded membership, until the gradient of each source is
below ``TOLERANCE`` of the total. Up to LOCAL_GROUPS groups are fitted in one place; with more, each step is a job that
sends a few matrices of the size of the sources to the driver.

Sizes are tokens of a public tokenizer, counted over whole texts of all documents.

Defined results: sources are compared trimmed and lower-cased; documents of other and NULL sources are left out; a
NULL text has no tokens; a wanted source without documents has size 0; repeated rows of a document count once.
"""

from __future__ import annotations

import base64
import warnings

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspan.session import cut, ship_file, shipped

TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
# Fixed value: the pattern that splits text before the merges of the rank file.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Labelled rows that train the classifier, about; buckets that token ids are hashed into.
TRAIN_ROWS, BUCKETS = 10_000, 2048
#: Of the sample, one part in so many is held out; the temperatures and shares of wrong labels that are tried on it.
HELD_OUT, TEMPERATURES, WRONG = 5, 2.0 ** np.arange(0, 11), (1e-3, 3e-3, 0.01, 0.02, 0.05, 0.1, 0.2, 0.3)
#: Log likelihood that the best pair must gain on the held-out part over labels that are right and texts that tell nothing.
GAIN = 3.0
#: Groups of documents up to which the fit runs in one place; texts that are scored at a time.
LOCAL_GROUPS, SCORED = 100_000, 500
#: Decimals that memberships are rounded to before documents are grouped.
DECIMALS = 2
#: Weight of the distance of rates from 1, at first and at last; the bound on each source's gradient, as a share of the
#: total; lengths tried for a step; steps after which the fit is given up and reported as not converged.
PENALTY, TOLERANCE, LENGTHS, STEPS = (1e-2, 1e-6), 1e-10, 2.0 ** -np.arange(8), 400

_encoders: dict = {}


def encoder(path: str):
    if path not in _encoders:
        import tiktoken

        with open(shipped(path), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _encoders[path] = tiktoken.Encoding("mixing", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encoders[path]


def wanted(targets: DataFrame) -> list[tuple[str, float, int]]:
    """(source, target_share, max_repeats) by source; the table of wanted sources is a setting and stays small."""
    rows = targets.where("source IS NOT NULL").groupBy("source").agg(F.max("target_share").alias("w"), F.max("max_repeats").alias("m")).collect()
    return sorted((r.source, float(r.w or 0), int(r.m or 0)) for r in rows)


def labelled(documents: DataFrame, sources: list[str]) -> DataFrame:
    """(doc_id, label, text) of the documents of wanted sources; ``label`` is the place in ``sources``."""
    at = F.create_map(*[x for i, s in enumerate(sources) for x in (F.lit(s.strip().lower()), F.lit(i))]) if sources else F.lit(None)
    label = at[F.lower(F.trim(F.regexp_replace("source", r"(?U)^\s+|\s+$", "")))] if sources else F.lit(None).cast("int")
    return documents.where("doc_id IS NOT NULL").select("doc_id", label.alias("label"), "text").where("label IS NOT NULL")


class Classifier:
    """Log weights [BUCKETS + 1, k], the prior in the last row, with temperature and share of wrong labels."""

    def __init__(self, weights: np.ndarray, temperature: float = 1.0, wrong: float = WRONG[0]):
        self.weights, self.temperature, self.wrong = weights, temperature, wrong

    def scores(self, ids: list[np.ndarray]) -> np.ndarray:
        """Log likelihoods [text, k] of texts as token ids, without the prior."""
        w, out = self.weights[:BUCKETS].astype(np.float32), []
        for a in range(0, len(ids), SCORED):
            counts = np.zeros((len(ids[a : a + SCORED]), BUCKETS), dtype=np.float32)
            for row, x in enumerate(ids[a : a + SCORED]):
                counts[row] = np.bincount(x % BUCKETS, minlength=BUCKETS)
            out.append(counts @ w)
        return np.vstack(out) if out else np.empty((0, self.weights.shape[1]))

    def posterior(self, scores: np.ndarray) -> np.ndarray:
        """What the text alone says."""
        s = scores / self.temperature + self.weights[BUCKETS]
        p = np.exp(s - s.max(axis=1, keepdims=True))
        return p / p.sum(axis=1, keepdims=True)

    def given(self, label: np.ndarray) -> np.ndarray:
        """The probability of each label if the text belongs to each source."""
        k = self.weights.shape[1]
        out = np.full((len(label), k), self.wrong / max(k - 1, 1))
        out[np.arange(len(label)), label] = 1 - self.wrong if k > 1 else 1.0
        return out

    def membership(self, scores: np.ndarray, label: np.ndarray) -> np.ndarray:
        q = self.posterior(scores) * self.given(label)
        return q / q.sum(axis=1, keepdims=True)


def train(docs: DataFrame, k: int, path: str, rows: int = TRAIN_ROWS) -> Classifier:
    """The classifier of about ``rows`` labelled documents."""
    n = docs.count()
    share = int(min(1.0, rows / max(n, 1)) * 1_000_000)
    drawn = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000))
    held = F.pmod(F.xxhash64("doc_id", F.lit("held out")), F.lit(HELD_OUT)) == 0
    sample = docs.where(drawn < share)

    def count(batches):
        enc, total = encoder(path), np.zeros((k, BUCKETS + 1))
        for pdf in batches:
            for label, text in zip(pdf.label, pdf.text):
                ids = np.array(enc.encode_ordinary(text or ""), dtype=np.int64) % BUCKETS
                total[label, :BUCKETS] += np.bincount(ids, minlength=BUCKETS)
                total[label, BUCKETS] += 1
        a, b = np.nonzero(total)
        yield pd.DataFrame({"cell": a * (BUCKETS + 1) + b, "n": total[a, b]})

    counts = np.zeros(k * (BUCKETS + 1))
    # at most k * (BUCKETS + 1) cells, whatever the number of documents
    for r in sample.where(~held).mapInPandas(count, "cell bigint, n double").groupBy("cell").agg(F.sum("n").alias("n")).toLocalIterator():
        counts[r.cell] = r.n
    counts = counts.reshape(k, BUCKETS + 1)
    words = counts[:, :BUCKETS] + 0.5
    prior = counts[:, BUCKETS] + 1.0
    out = Classifier(np.vstack([np.log(words / words.sum(axis=1, keepdims=True)).T, np.log(prior / prior.sum())]))

    def score(batches):
        enc = encoder(path)
        for pdf in batches:
            s = out.scores([np.array(enc.encode_ordinary(t or ""), dtype=np.int64) for t in pdf.text])
            yield pd.DataFrame({"label": pdf.label, "s": list(s.astype(np.float64))})

    held_out = sample.where(held).mapInPandas(score, "label int, s array<double>").toPandas()  # a part of a bounded sample
    if len(held_out) and k > 1:
        s, label = np.vstack(held_out.s.to_list()), held_out.label.to_numpy()

        def value(t: float, wrong: float) -> float:
            m = Classifier(out.weights, t, wrong)
            return float(np.log((m.posterior(s) * m.given(label)).sum(axis=1)).sum())

        tried = [(value(float(t), w), float(t), w) for t in TEMPERATURES for w in WRONG]
        plain = (float(TEMPERATURES[-1]), WRONG[0])  # texts tell nothing, labels are right
        best = max(tried)
        out.temperature, out.wrong = best[1:] if best[0] > value(*plain) + GAIN else plain
    return out


def members(docs: DataFrame, model: Classifier, path: str) -> DataFrame:
    """(doc_id, label, tokens, q): one pass over all texts; ``q`` is the rounded membership."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def go(batches):
        enc, m = encoder(path), shared.value
        for pdf in batches:
            ids = [np.array(enc.encode_ordinary(text or ""), dtype=np.int64) for text in pdf.text]
            q = m.membership(m.scores(ids), pdf.label.to_numpy()) if len(pdf) else np.empty((0, 1))
            q = pd.Series(list(np.round(q, DECIMALS)), dtype=object, index=pdf.index)
            yield pd.DataFrame({"doc_id": pdf.doc_id, "label": pdf.label, "tokens": pd.Series([len(x) for x in ids], dtype="int64", index=pdf.index), "q": q})

    return docs.mapInPandas(go, "doc_id bigint, label int, tokens bigint, q array<double>").dropDuplicates(["doc_id"])


def _rates(q: np.ndarray, cap: np.ndarray, prices: np.ndarray) -> np.ndarray:
    """Rates at the given prices; a rate follows from the prices alone, so none is ever stored."""
    return np.clip(1.0 - q @ prices, 0.0, cap)


def fit(groups: DataFrame, caps: list[int], target: np.ndarray, steps: int = STEPS) -> tuple[np.ndarray, bool]:
    """Prices of the sources over (label, q, tokens), see ``_rates``, and whether they converged.

    The penalty falls tenfold from one value to the next, each starting from the prices before; at each the prices
    minimise a convex function of as many variables as there are sources, whose gradient is target + penalty * prices -
    totals. Few large sources and many small ones make no difference to a Newton step."""
    k, cap_of = len(caps), np.array(caps, dtype=float)
    cells = 1 + k + k * k

    total = groups.agg(F.sum("tokens")).first()[0] or 0
    if not total:
        return np.zeros(k), True

    near = groups.select("label", "q", "tokens").toPandas() if groups.count() <= LOCAL_GROUPS else None

    def sums(points):
        """For each point: value, totals and curvature, in one pass."""

        def go(batches):
            out = np.zeros((len(points), cells))
            for pdf in batches:
                if len(pdf):
                    q, cap, w = np.vstack(pdf.q.to_list()), cap_of[pdf.label.to_numpy()], pdf.tokens.to_numpy() / total
                    for n, z in enumerate(points):
                        u, r = q @ z, _rates(q, cap, z)
                        free = (1.0 - u > 0.0) & (1.0 - u < cap)
                        out[n, 0] += w @ (0.5 * (r - 1.0) ** 2 + u * r)
                        out[n, 1 : k + 1] += (w * r) @ q
                        out[n, k + 1 :] += ((q * (w * free)[:, None]).T @ q).ravel()
            yield pd.DataFrame({"cell": np.arange(out.size), "v": out.ravel()})

        if near is not None:
            return next(go([near])).v.to_numpy().reshape(len(points), cells)
        got = np.zeros(len(points) * cells)
        for r in groups.mapInPandas(go, "cell int, v double").groupBy("cell").agg(F.sum("v").alias("v")).toLocalIterator():  # few cells
            got[r.cell] = r.v
        return got.reshape(len(points), cells)

    def local(z, row, penalty):
        gradient = target + penalty * z - row[1 : k + 1]
        return target @ z + penalty / 2 * (z @ z) - row[0], gradient, row[k + 1 :].reshape(k, k) + penalty * np.eye(k)

    z, penalty = np.zeros(k), PENALTY[0]
    row = sums([z])[0]
    for _ in range(steps):
        value, gradient, curve = local(z, row, penalty)
        while np.abs(gradient).max() < TOLERANCE:
            if penalty <= PENALTY[1] * 1.001:
                return z, True
            penalty /= 10
            value, gradient, curve = local(z, row, penalty)
        way = -np.linalg.solve(curve, gradient)
        points = [z + a * way for a in LENGTHS]
        tried = sums(points)
        values = [local(p, t, penalty)[0] for p, t in zip(points, tried)]
        best = 0 if values[0] <= value + 1e-4 * (gradient @ way) else int(np.argmin(values))
        z, row = points[best], tried[best]
    return z, False


class Mixture:
    """The fitted mixture: memberships, rates and the report."""

    def __init__(self, documents: DataFrame, targets: DataFrame, path: str = TOKENIZER):
        self.spark = documents.sparkSession
        ship_file(self.spark, path)
        self.sources = wanted(targets)
        k = len(self.sources)
        docs = labelled(documents, [s for s, _, _ in self.sources])
        self.caps = [m for _, _, m in self.sources]
        self.model = train(docs, k, path) if k else Classifier(np.zeros((BUCKETS + 1, 0)))
        self.members = cut(members(docs, self.model, path)) if k else self.spark.createDataFrame([], "doc_id bigint, label int, tokens bigint, q array<double>")
        self.groups = cut(self.members.groupBy("label", "q").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("n")))
        self.prices, self.converged = fit(self.groups, self.caps, np.array([w for _, w, _ in self.sources]))
        if not self.converged:
            warnings.warn("the fit of the mixture did not converge; its rates miss targets that could be met", stacklevel=2)

    def _rated(self, df: DataFrame) -> DataFrame:
        caps, prices = np.array(self.caps, dtype=float), self.prices

        def go(batches):
            for pdf in batches:
                rate = _rates(np.vstack(pdf.q.to_list()), caps[pdf.label.to_numpy()], prices) if len(pdf) else []
                yield pdf.assign(rate=rate)

        return df.mapInPandas(go, ", ".join(f"{n} {t}" for n, t in df.dtypes) + ", rate double")

    def rates(self) -> DataFrame:
        """(doc_id, source, tokens, rate, copies): whole copies plus one more by the hash of the id for the rest."""
        names = F.array(*[F.lit(s) for s, _, _ in self.sources]) if self.sources else F.array().cast("array<string>")
        draw = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003)) / 1_000_003
        return self._rated(self.members).select(
            "doc_id", F.element_at(names, F.col("label") + 1).alias("source"), "tokens", "rate",
            (F.floor("rate") + (draw < F.col("rate") - F.floor("rate")).cast("int")).cast("int").alias("copies"),
        )

    def report(self) -> DataFrame:
        """One row per wanted source. ``label_share`` is the part of what is taken by the documents' labels,
        ``expected_share`` by their memberships; ``expected_of_total``, the expected tokens as a part of the total of all
        sources, is what the fit brings near the target, and ``gap`` is how far it stays below. ``short``: even
        ``max_repeats`` copies of all the source's documents stay below its share of the total; ``converged`` is the
        fit's."""
        rated = self._rated(self.groups).withColumn("taken", F.col("tokens") * F.col("rate"))
        by_label = rated.groupBy("label").agg(F.sum("tokens").alias("size_tokens"), F.sum("taken").alias("taken_tokens"), F.sum("n").alias("n_docs"))
        parts = rated.select("taken", F.posexplode("q").alias("label", "m"))
        by_member = parts.groupBy("label").agg(F.sum(F.col("taken") * F.col("m")).alias("expected_tokens"))
        want = self.spark.createDataFrame(
            [(i, s, w, m) for i, (s, w, m) in enumerate(self.sources)], "label int, source string, target_share double, max_repeats int"
        )
        got = cut(by_label.join(by_member, "label", "full"))  # at most one row per wanted source
        sums = got.agg(F.sum("size_tokens").alias("total"), F.sum("taken_tokens").alias("taken"), F.sum("expected_tokens").alias("expected")).first()
        part = lambda c, whole: (F.col(c) / F.lit(float(whole)) if whole else F.lit(0.0))
        total = sums.total or 0
        rows = want.join(got, "label", "left").na.fill(0)
        return rows.select(
            "source", "target_share", "max_repeats", "n_docs", "size_tokens", F.lit(total).cast("bigint").alias("total_tokens"),
            part("taken_tokens", sums.taken).alias("label_share"), part("expected_tokens", sums.expected).alias("expected_share"),
            part("expected_tokens", total).alias("expected_of_total"), (F.col("target_share") - part("expected_tokens", total)).alias("gap"),
            (F.col("max_repeats") * F.col("size_tokens") < F.col("target_share") * F.lit(total)).alias("short"),
            F.lit(self.converged).alias("converged"),
        )
