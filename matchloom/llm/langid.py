"""Language identification by segmentation-marginalised unigrams.

A fixed public vocabulary gives the pieces. A word (a run of letters, lower case, a word-start mark before it) has many
segmentations into pieces; the forward algorithm sums the probabilities of them all. One expectation step from equal
piece weights over the training words gives expected piece counts per language, smoothed to piece probabilities. A text
scores by its words' log probabilities plus the log prior of the language; the score is the winner's posterior.

Words of any length are learned from and scored whole, very long texts too; repeated rows are judged alike; extra columns
are ignored. Null text, or text without a letter: "und", score 0. Ties go to the language first by code point. Empty tables
give empty results; without any training row every text is "und".
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fields

LETTERS = regex.compile(r"\p{L}[\p{L}\p{M}]*")
MARK = "▁"
UNKNOWN = 1e-3  # weight of an unknown character against that of a piece, for the expected counts
_BASE = np.uint64(0x9E3779B97F4A7C15)


def vocabulary(path: str | None = None) -> list[str]:
    """The pieces of a public sentencepiece model, without control and byte pieces."""
    import sentencepiece

    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    return sorted({sp.id_to_piece(i).lower() for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))})


class Pieces:
    """Finds pieces in many words at once: an open hash table over polynomial hashes of code points."""

    def __init__(self, pieces: list[str]):
        self.pieces, self.longest = pieces, max(map(len, pieces))
        with np.errstate(over="ignore"):
            self.power = np.cumprod(np.full(self.longest + 1, _BASE, dtype=np.uint64))
        keys = np.array([self.hashed(p) for p in pieces], dtype=np.uint64)
        self.bits = 18
        size = 1 << self.bits
        self.key, self.id = np.zeros(size, dtype=np.uint64), np.full(size, -1, dtype=np.int32)
        self.probes = 1
        for i, (k, s) in enumerate(zip(keys.tolist(), self.slot(keys).tolist())):
            n = 1
            while self.id[s] >= 0:
                s, n = (s + 1) % size, n + 1
            self.key[s], self.id[s], self.probes = k, i, max(self.probes, n)

    def slot(self, keys):
        return ((keys * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def hashed(self, s: str) -> int:
        h = 0
        for c in s:
            h = (h * int(_BASE) + ord(c) + 1) & 0xFFFFFFFFFFFFFFFF
        return h

    def find(self, keys):
        at, mask = self.slot(keys), (1 << self.bits) - 1
        out = np.where(self.key[at] == keys, self.id[at], -1)
        for _ in range(self.probes - 1):
            rest = np.nonzero((out < 0) & (self.id[at] >= 0))[0]
            if not len(rest):
                break
            at[rest] = (at[rest] + 1) & mask
            out[rest] = np.where(self.key[at[rest]] == keys[rest], self.id[at[rest]], -1)
        return out

    def hashes(self, words: list[str]) -> np.ndarray:
        """For words of one length: running hashes over their code points."""
        n = len(words[0])
        codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).reshape(len(words), n).astype(np.uint64) + np.uint64(1)
        h = np.zeros((len(words), n + 1), dtype=np.uint64)
        for i in range(n):
            h[:, i + 1] = h[:, i] * _BASE + codes[:, i]
        return h

    def between(self, h: np.ndarray, i: int, j: int) -> np.ndarray:
        """Ids of the pieces that the words hold from i to j, or -1."""
        return self.find(h[:, j] - h[:, i] * self.power[j - i - 1])

    def lattice(self, words: list[str]) -> list[np.ndarray]:
        """For words of one length: ids[d - 1][k, i], the piece that word k holds from i to i + d, or -1."""
        h = self.hashes(words)
        return [self.find((h[:, d:] - h[:, :-d] * self.power[d - 1]).ravel()).reshape(len(words), -1) for d in range(1, min(self.longest, len(words[0])) + 1)]


def by_length(words):
    out: dict[int, list[str]] = {}
    for w in words:
        out.setdefault(len(w), []).append(w)
    return out.values()


def words_of(text: str | None) -> list[str]:
    return LETTERS.findall(text.lower()) if text else []


def log_sums(ids: list[np.ndarray], flat: float, back: bool) -> np.ndarray:
    """log_sums[k, i]: the log of the sum over all segmentations of word k before place i, or from it on if `back`.

    The sums run through a window as long as the longest piece, put back in range as they go.
    """
    rows, n = ids[0].shape
    width = len(ids) + 1
    a, log, out = np.zeros((width, rows)), np.zeros(rows), np.zeros((rows, n + 1))
    a[0] = 1.0
    for i in range(n + 1):
        if i and i % 8 == 0:
            top = a.max(axis=0)
            a /= top
            log += np.log(top)
        here = a[i % width].copy()
        out[:, n - i if back else i] = np.log(here) + log
        a[i % width] = 0.0
        for d in range(1, min(len(ids), n - i) + 1):
            weight = np.where(ids[d - 1][:, n - i - d if back else i] >= 0, flat, UNKNOWN * flat if d == 1 else 0.0)
            a[(i + d) % width] += here * weight
    return out


def expected_counts(pieces: Pieces, counts: Counter) -> np.ndarray:
    """Expected piece counts of the words under equal piece weights; one more place for unknown characters."""
    v = len(pieces.pieces)
    out, flat = np.zeros(v + 1), 1.0 / v
    for group in by_length(MARK + w for w in counts):
        step = max(1, 4096 * 48 // max(48, len(group[0])))
        for at in range(0, len(group), step):
            words = group[at : at + step]
            ids = pieces.lattice(words)
            before, after = log_sums(ids, flat, False), log_sums(ids, flat, True)
            times = np.array([counts[w[1:]] for w in words], dtype=float)
            for d, found in enumerate(ids, 1):
                k, i = np.nonzero(found >= 0) if d > 1 else map(np.ravel, np.indices(found.shape))
                piece = found[k, i]
                share = before[k, i] + after[k, i + d] - after[k, 0] + np.where(piece >= 0, np.log(flat), np.log(UNKNOWN * flat))
                out += np.bincount(np.where(piece >= 0, piece, v), weights=np.exp(share) * times[k], minlength=v + 1)
    return out


def word_scores(pieces: Pieces, probs: np.ndarray, words: list[str]) -> np.ndarray:
    """Log probability of every word under every language (probs: language x piece), all segmentations summed.

    Words of any length: the sums run through a window as long as the longest piece, put back in range as they go.
    """
    out = {}
    for group in by_length({MARK + w for w in words}):
        n = len(group[0])
        step = max(1, 4096 * 48 // max(48, n))
        for at in range(0, len(group), step):
            some = group[at : at + step]
            h = pieces.hashes(some)
            width = pieces.longest + 1
            a = np.zeros((width, len(some), len(probs)))  # place i stands at i modulo width
            a[0] = 1.0
            log = np.zeros((len(some), len(probs)))
            for i in range(n):
                if i and i % 8 == 0:  # one factor for the places still open
                    top = np.maximum(a.max(axis=(0, 2)), 1e-300)
                    a /= top[None, :, None]
                    log += np.log(top)[:, None]
                here = a[i % width]
                for j in range(i + 1, min(n, i + pieces.longest) + 1):
                    ids = pieces.between(h, i, j)
                    if j - i == 1:
                        a[j % width] += here * probs.T[ids]  # the last row is that of unknown characters
                    else:
                        hit = np.nonzero(ids >= 0)[0]
                        if len(hit):
                            a[j % width, hit] += here[hit] * probs.T[ids[hit]]
                a[i % width] = 0.0
            log += np.log(np.maximum(a[n % width], 1e-300))
            out.update(zip(some, log))
    return np.array([out[MARK + w] for w in words]) if words else np.zeros((0, len(probs)))


def learn(docs: DataFrame, pieces: list[str], smooth: float = 0.05):
    """Languages, log priors and piece probabilities from docs(text, lang). The driver gets vocabulary x languages numbers at most."""
    def count(batches):
        finder, sums, rows = Pieces(pieces), {}, Counter()
        pending: dict[str, Counter] = {}

        def flush():
            for lang, c in pending.items():
                sums[lang] = sums.get(lang, 0) + expected_counts(finder, c)
            pending.clear()

        for b in batches:
            for text, lang in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                pending.setdefault(lang, Counter()).update(words_of(text))
                rows[lang] += 1
                if len(pending[lang]) > 200_000:
                    flush()
        flush()
        for lang, s in sums.items():
            at = np.nonzero(s)[0]
            yield pa.RecordBatch.from_arrays([pa.array([lang] * (len(at) + 1)), pa.array(np.append(at, -1).astype(np.int32)), pa.array(np.append(s[at], rows[lang]))], names=["lang", "piece", "n"])

    got = docs.where("lang is not null").select("text", "lang").mapInArrow(count, fields(("lang", "string"), ("piece", "int"), ("n", "double")))
    got = got.groupBy("lang", "piece").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(got["lang"].unique())
    n = np.zeros((len(langs), len(pieces) + 1))
    seen = np.zeros(len(langs))
    for k, lang in enumerate(langs):
        own = got[got["lang"] == lang]
        has = own[own["piece"] >= 0]
        n[k, has["piece"]] = has["n"]
        seen[k] = own.loc[own["piece"] < 0, "n"].sum()
    probs = n + smooth
    probs /= probs.sum(axis=1, keepdims=True) if len(langs) else 1
    probs[:, -1] = 1e-9  # an unknown character tells nothing
    return langs, np.log(seen / seen.sum()) if len(langs) else seen, probs


def identify(docs: DataFrame, model, pieces: list[str], keep: list[str]) -> DataFrame:
    """The columns `keep` of docs with lang_pred and score."""
    spark = docs.sparkSession
    langs, prior, probs = model
    shared = spark.sparkContext.broadcast((pieces, langs, prior, probs))  # vocabulary x languages numbers
    kinds = [docs.schema[c] for c in keep]

    def predict(batches):
        names, langs, prior, probs = shared.value
        finder, cache, table, used = Pieces(names), {}, np.zeros((1 << 18, max(1, len(langs)))), 0
        for b in batches:
            preds, scores = [], []
            texts = b.column(len(keep)).to_pylist()
            for at in range(0, len(texts), 256):
                docs_words = [words_of(t) for t in texts[at : at + 256]]
                fresh = {w for ws in docs_words for w in ws if w not in cache} if langs else set()
                if used + len(fresh) > len(table):
                    cache, used = {}, 0
                    fresh = {w for ws in docs_words for w in ws}
                    if len(fresh) > len(table):
                        table = np.zeros((2 * len(fresh), len(langs)))
                fresh = list(fresh)
                if fresh:
                    table[used : used + len(fresh)] = word_scores(finder, probs, fresh)
                    cache.update(zip(fresh, range(used, used + len(fresh))))
                    used += len(fresh)
                for ws in docs_words:
                    if not ws or not langs:
                        preds.append("und")
                        scores.append(0.0)
                        continue
                    s = table[np.fromiter(map(cache.__getitem__, ws), dtype=np.int64, count=len(ws))].sum(axis=0) + prior
                    k = int(s.argmax())
                    preds.append(langs[k])
                    scores.append(float(1 / np.exp(np.minimum(s - s[k], 0)).sum()))
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], pa.array(preds, pa.string()), pa.array(scores, pa.float64())], names=[*keep, "lang_pred", "score"])

    schema = fields(*[(f.name, f.dataType) for f in kinds], ("lang_pred", "string"), ("score", "double"))
    return docs.select(*keep, "text").mapInArrow(predict, schema)


def digest(docs: DataFrame, vocab_path: str | None = None) -> DataFrame:
    pieces = vocabulary(vocab_path)
    fold = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 4
    rows = docs.select("doc_id", "text", "lang", (fold == 2).alias("held_out"))
    model = learn(rows.where("not held_out"), pieces)
    return identify(rows, model, pieces, ["doc_id", "held_out"])
