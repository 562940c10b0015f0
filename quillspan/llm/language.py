"""Languages of documents and of the segments inside them, by segmentation-marginalised unigrams.

Each language has probabilities over the pieces of a fixed public vocabulary. The probability of a word is the sum
over all its segmentations into pieces (forward algorithm); piece probabilities are trained by expectation
maximisation on a bounded sample of labelled documents, whose sentences are cleaned of wrong labels with the model
of the round before. Sentences are scored by their words, and the best path over a document's sentences, with a cost
for each change of language, gives its segments. Headers, speaker labels, markup and code carry no evidence.

Defined results: a document without any word (NULL, empty, only code or digits) has no segment; words of more than
``MAX_WORD`` letters are scored in parts; repeated rows count once; labels in another spelling of the right language
are right, NULL, blank and placeholder labels are not. Extra columns are ignored.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspan.session import ship_file, shipped

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
LANGS = ("en", "de", "fr", "es", "nl", "pt", "ru")

# Spellings of each language (two- and three-letter codes, English and own names); regions are cut off.
ALIASES = {
    "en": ("en", "eng", "english", "englisch", "anglais", "inglés"),
    "de": ("de", "deu", "ger", "german", "deutsch", "allemand", "alemán"),
    "fr": ("fr", "fra", "fre", "french", "français", "francais", "französisch"),
    "es": ("es", "spa", "spanish", "español", "espanol", "castellano", "castilian", "spanisch"),
    "nl": ("nl", "nld", "dut", "dutch", "nederlands", "vlaams", "flemish", "niederländisch"),
    "pt": ("pt", "por", "portuguese", "português", "portugues", "portugiesisch"),
    "ru": ("ru", "rus", "russian", "русский", "russisch"),
}
#: Labelled documents per language that train the model, and the words per language that are kept of them.
TRAIN_DOCS, TRAIN_WORDS, TRAIN_CHARS, ROUNDS, EM_STEPS = 300, 3000, 20_000, 2, 3
SMOOTHING = 0.05
#: Cost of a change of language, and the most that one word may count against a language, in nats.
SWITCH, WORD_CAP = 9.0, 7.0
#: Words of a text are far from independent: the weight of their evidence in a confidence. It is fitted on CALIBRATE_DOCS
#: labelled documents a language that did not train the model, of which WRONG_LABELS may be wrong; the first value holds
#: where there are fewer than LEAST_HELD in all.
TEMPER, TEMPERS = 0.1, (0.02, 0.03, 0.05, 0.07, 0.1, 0.15, 0.2, 0.3, 0.5, 1.0)
CALIBRATE_DOCS, LEAST_HELD, WRONG_LABELS = 100, 50, 0.05
MAX_WORD, KEEP_WORDS = 40, 200_000

_TOKEN = re.compile(r"[^\W\d_]+|[.!?…。！？]+[\"'”’»)\]*_]*(?=\s|$)|\n\s*\n")
_NOISE = re.compile(
    r"(?:```|~~~)\w*[ \t]*\n(?:.*?\n[ \t>|*_-]*(?:```|~~~)|.*?(?=\n\s*\n|\Z))"  # fenced code; unclosed: to a blank line
    r"|\A\s*---[ \t]*\n.*?^---[ \t]*$"  # leading metadata block
    r"|^[ \t>|*_-]*(?:from|sent|to|cc|bcc|date|subject|reply-to|title|tags|von|gesendet|an|betreff|de|para|assunto|asunto|objet|à|van|aan|onderwerp|от|кому|тема)[*_]{0,2}:[*_]{0,2} [^\n]*$"
    r"|^[ \t#>*_-]*(?:human|assistant|user|you|copilot|ai|bot|system)(?: said)?[*_]{0,2}[ \t]*:?[*_]{0,2}:?[ \t]*(?=$|(?<=:)\s|(?<=\*)\s)"
    r"|^[ \t]*page \d+ of \d+[ \t]*$|https?://\S+|www\.\S+|\S+@\S+|\[[^\]\n]{0,40}\]|<[^>\n]{1,80}>|`[^`\n]*`",
    re.I | re.M | re.S,
)


def tokens(text: str) -> list[str]:
    """Words in lower case and sentence ends, in text order."""
    return _TOKEN.findall(_NOISE.sub("\n\n", text.replace("\r", "")).lower())


def label_language(c) -> F.Column:
    """The language that a label names, NULL if none of LANGS."""
    plain = F.regexp_extract(F.lower(F.regexp_replace(c, r"(?U)^\s+|\s+$", "")), r"^([\p{L}\p{N}]+)", 1)
    table = F.create_map(*[x for k, names in ALIASES.items() for n in names for x in (F.lit(n), F.lit(k))])
    return table[plain]


class Lattice:
    """The vocabulary's pieces inside words; a character outside the vocabulary is a piece of its own."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.ids = {p: i for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i)) for p in (sp.id_to_piece(i),) if p == p.lower()}
        self.longest = max(map(len, self.ids))
        self.unknown = len(self.ids) and max(self.ids.values()) + 1
        self.size = self.unknown + 1

    def edges(self, word: str) -> list[tuple[int, int, int]]:
        """(start, end, piece) of all pieces of the word, by start."""
        x, out = "▁" + word, []
        for i in range(len(x)):
            single = False
            for j in range(i + 1, min(len(x), i + self.longest) + 1):
                p = self.ids.get(x[i:j])
                if p is not None:
                    out.append((i, j, p))
                    single |= j == i + 1
            if not single:
                out.append((i, i + 1, self.unknown))
        return out


def forward(edges: list[tuple[int, int, int]], n: int, p: np.ndarray) -> np.ndarray:
    """alpha[i, language]: the probability of the first i characters, summed over all segmentations."""
    alpha = np.zeros((n + 1, p.shape[1]))
    alpha[0] = 1.0
    for i, j, k in edges:
        alpha[j] += alpha[i] * p[k]
    return alpha


class Model:
    """Piece probabilities of each language and the scores of the words met lately."""

    def __init__(self, p: np.ndarray, lattice: Lattice):
        self.p, self.lattice = p, lattice
        self.clear()

    def clear(self) -> None:
        self.place: dict[str, int] = {}
        self.rows = np.zeros((4096, len(LANGS)))
        self.n = 1  # row 0: a sentence end

    def word(self, w: str) -> np.ndarray:
        """Log-probability per language, the best at 0 and none below -WORD_CAP."""
        total = np.zeros(len(LANGS))
        for at in range(0, len(w), MAX_WORD):
            part = w[at : at + MAX_WORD]
            total += np.log(np.maximum(forward(self.lattice.edges(part), len(part) + 1, self.p)[-1], 1e-300))
        return np.maximum(total - total.max(), -WORD_CAP)

    def index(self, ts: list[str]) -> list[int]:
        place, out = self.place, []
        for t in ts:
            k = place.get(t)
            if k is None:
                if t[0].isalpha():
                    if self.n == len(self.rows):
                        self.rows = np.vstack([self.rows, np.zeros_like(self.rows)])
                    k = self.n
                    self.rows[k] = self.word(t)
                    self.n += 1
                else:
                    k = 0
                place[t] = k
            out.append(k)
        return out


def train_pieces(sentences: list[tuple[int, list[str]]], lattice: Lattice) -> np.ndarray:
    """Piece probabilities [pieces, languages] from (language, words) by expectation maximisation."""
    k = len(LANGS)
    counts: list[dict[str, int]] = [{} for _ in range(k)]
    for lang, ws in sentences:
        c = counts[lang]
        for w in ws:
            c[w] = c.get(w, 0) + 1
    table: dict[str, np.ndarray] = {}
    for lang, c in enumerate(counts):
        for w, n in sorted(c.items(), key=lambda x: (-x[1], x[0]))[:TRAIN_WORDS]:
            table.setdefault(w[:MAX_WORD], np.zeros(k))[lang] += n
    lattices = [(lattice.edges(w), len(w) + 1, n) for w, n in table.items()]
    used = np.zeros(lattice.size, bool)
    for edges, _, _ in lattices:
        used[[e[2] for e in edges]] = True
    used[lattice.unknown] = True
    p = np.where(used[:, None], 1.0 / used.sum(), 1e-9).repeat(k, axis=1) if used.any() else np.full((lattice.size, k), 1e-9)
    for _ in range(EM_STEPS):
        expected = np.zeros((lattice.size, k))
        for edges, n, c in lattices:
            alpha = forward(edges, n, p)
            beta = np.zeros((n + 1, k))
            beta[n] = 1.0
            for i, j, q in reversed(edges):
                beta[i] += p[q] * beta[j]
            scale = c / np.maximum(alpha[n], 1e-300)
            for i, j, q in edges:
                expected[q] += alpha[i] * p[q] * beta[j] * scale
        total = expected.sum(axis=0)
        p = (expected + SMOOTHING) / (total + SMOOTHING * lattice.size)
    return p


def sentence_scores(index: np.ndarray, docs: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Scores [sentence, language] and the document of each sentence that has a word; ``index`` holds row numbers,
    0 for a sentence end, ``docs`` the document of each."""
    if not len(index):
        return np.zeros((0, len(LANGS))), np.zeros(0, np.int64)
    fresh = np.ones(len(index), bool)
    fresh[1:] = (index[:-1] == 0) | (docs[1:] != docs[:-1])
    first = np.nonzero(fresh)[0]
    scores = np.add.reduceat(rows[index], first, axis=0)
    worded = np.maximum.reduceat(index, first) > 0
    return scores[worded], docs[first][worded]


def best_path(scores: np.ndarray) -> np.ndarray:
    """The language of each sentence on the best path."""
    n, k = scores.shape
    total = scores.sum(axis=0)
    one = int(np.argmax(total))
    if (scores.max(axis=1).sum() - total[one]) <= SWITCH:  # no path with a change can be better
        return np.full(n, one)
    best, back = scores[0].copy(), np.zeros((n, k), dtype=np.int64)
    for i in range(1, n):
        top = int(np.argmax(best))
        stay = best >= best[top] - SWITCH
        back[i] = np.where(stay, np.arange(k), top)
        best = np.where(stay, best, best[top] - SWITCH) + scores[i]
    out = np.zeros(n, dtype=np.int64)
    out[-1] = int(np.argmax(best))
    for i in range(n - 1, 0, -1):
        out[i - 1] = back[i, out[i]]
    return out


def calibrated(totals: np.ndarray, langs: np.ndarray) -> float:
    """The weight of evidence under which held-out labels are likeliest, given the documents' scores [doc, language]."""
    if len(langs) < LEAST_HELD:
        return TEMPER

    def value(t: float) -> float:
        p = np.exp(t * (totals - totals.max(axis=1, keepdims=True)))
        p = p[np.arange(len(langs)), langs] / p.sum(axis=1)
        return float(np.log((1 - WRONG_LABELS) * p + WRONG_LABELS / len(LANGS)).sum())

    return max(TEMPERS, key=value)


def train(documents: DataFrame, path: str = VOCABULARY) -> tuple[np.ndarray, float]:
    """Piece probabilities from at most TRAIN_DOCS labelled documents a language (the sample bound), and the weight of
    evidence in confidences from at most CALIBRATE_DOCS more."""
    labelled = documents.where(F.length("text") <= TRAIN_CHARS).select("doc_id", label_language(F.col("lang")).alias("l"), "text").where("l IS NOT NULL")
    w = Window.partitionBy("l").orderBy(F.xxhash64("doc_id"), "doc_id")
    sample = labelled.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= TRAIN_DOCS + CALIBRATE_DOCS).select("doc_id", "l", "rn", "text").collect()
    lattice = Lattice(path)
    sentences = []
    for r in sorted((r for r in sample if r.rn <= TRAIN_DOCS), key=lambda r: (r.l, r.doc_id)):
        ws: list[str] = []
        for t in [*tokens(r.text), "."]:
            if t[0].isalpha():
                ws.append(t)
            elif ws:
                sentences.append((LANGS.index(r.l), ws))
                ws = []
    p = train_pieces(sentences, lattice)
    for _ in range(ROUNDS - 1):
        m = Model(p, lattice)
        kept = []
        for lang, ws in sentences:
            index = m.index(ws)
            s = m.rows[index].sum(axis=0)
            top = int(np.argmax(s))
            if top == lang or np.sort(s)[-1] - np.sort(s)[-2] > SWITCH:
                kept.append((top, ws))
        p = train_pieces(kept, lattice)
    p, held = p.astype(np.float32), [r for r in sample if r.rn > TRAIN_DOCS]
    m = Model(p.astype(np.float64), lattice)
    totals = np.array([m.rows[m.index(tokens(r.text))].sum(axis=0) for r in held]).reshape(len(held), len(LANGS))
    return p, calibrated(totals, np.array([LANGS.index(r.l) for r in held], dtype=int))


def segments(documents: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """(doc_id, seg_no, lang, confidence, n_sentences, n_segments, label): the segments of every document in text
    order; ``confidence`` is the posterior of the segment's language given its sentences, the evidence tempered by
    what ``train`` fits and all languages equally likely beforehand; ``label`` is the language that the document's label names."""
    spark = documents.sparkSession
    ship_file(spark, path)
    shared = spark.sparkContext.broadcast(train(documents, path))
    docs = documents.where("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", "text", label_language(F.col("lang")).alias("label"))
    columns = ["doc_id", "seg_no", "lang", "confidence", "n_sentences", "n_segments", "label"]

    def go(batches):
        p, temper = shared.value
        model = Model(p.astype(np.float64), Lattice(shipped(path)))
        for pdf in batches:
            if model.n > KEEP_WORDS:
                model.clear()
            flat, lengths = [], []
            for text in pdf.text:
                ix = model.index(tokens(text))
                flat += ix
                lengths.append(len(ix))
            owner = np.repeat(np.arange(len(pdf)), lengths)
            scores, docs_of = sentence_scores(np.array(flat, dtype=np.int64), owner, model.rows)
            bounds = np.concatenate(([0], np.nonzero(np.diff(docs_of))[0] + 1, [len(docs_of)])) if len(docs_of) else [0]
            keys, labels, out = pdf.doc_id.tolist(), pdf.label.tolist(), []
            for a, b in zip(bounds[:-1], bounds[1:]):
                s = scores[a:b]
                way = best_path(s)
                cuts = [0, *(np.nonzero(np.diff(way))[0] + 1).tolist(), len(way)]
                d = int(docs_of[a])
                for no, (x, y) in enumerate(zip(cuts[:-1], cuts[1:])):
                    total = s[x:y].sum(axis=0)
                    out.append((keys[d], no, LANGS[way[x]], float(1.0 / np.exp(temper * (total - total[way[x]])).sum()), y - x, len(cuts) - 1, labels[d]))
            yield pd.DataFrame(out, columns=columns)

    return docs.mapInPandas(go, "doc_id bigint, seg_no int, lang string, confidence double, n_sentences int, n_segments int, label string")


def unlabelled_or_mixed(documents: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """(doc_id, seg_no, lang) of the documents with several languages or without a right label."""
    s = segments(documents, path)
    return s.where("n_segments > 1 OR label IS NULL OR label <> lang").select("doc_id", "seg_no", "lang").distinct()
