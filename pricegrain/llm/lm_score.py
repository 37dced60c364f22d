"""LM scoring with a subword lattice: the probability of a text is the sum over all its segmentations into pieces.

The pieces are those of an existing vocabulary file, whose scores give the first weights (the file's scores are ranks, so a
piece of rank r starts with a weight of 1 / (r + 10)). Expectation maximisation over the word counts of the training texts
then fits the piece probabilities: for each distinct word the forward and backward recursions in log space give the
expected uses of each piece. A text is a sequence of pieces closed by an end; words begin with a mark, so its probability
is the product over words of the words' marginals and of the end's probability. Characters without a piece are spelled in
byte pieces, so each text has a positive probability.

What is gathered from the corpus is the table of word counts, which grows with the input and stays distributed. Words are
counted within each task before the shuffle. The HEAD most frequent words are broadcast (a fixed number); of each
document only the other words are joined, so no frequent word is a hot key. A word of any length takes bounded memory beside
its own characters: it is walked in parts, and a part hands on the forward values of the places its pieces reach.

Defined cases: A-Z is lower-cased; words are `[^\\x20\\x09-\\x0D]+`; a null or empty text is an end alone; each row is scored
by itself and counts in training by itself, so ids may repeat; a row without an id is one to learn from; with no training text
all counts are 0 and the first weights stay; an empty table gives an empty result; columns besides doc_id and text are not read.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, read

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
HEAD = 200_000
PASSES = 4
SMOOTH = 0.05
#: Words of more characters are walked one by one, so many characters at a time; of the others CELLS characters are walked together.
LONG, CELLS = 2048, 1 << 20
MARK = 0x2581
_HIDDEN = 0x110001
_BASE = np.uint64(0x9E3779B97F4A7C15)
_SPREAD = np.uint64(0xD6E8FEB86659FD93)
_SLOT_BITS = 19
_LN10 = float(np.log(10.0))


def load_pieces(path: str = VOCABULARY) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Pieces that can occur in a word after its mark, their first weights, and the places of the 256 byte pieces."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces, weight, byte_at = [], [], np.zeros(256, dtype=np.int64)
    mark = chr(MARK)
    for i in range(sp.get_piece_size()):
        piece = sp.id_to_piece(i)
        if sp.is_byte(i):
            byte_at[int(piece[3:5], 16)] = len(pieces)
        elif sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) or mark in piece[1:] or any(c in " \t\n\x0b\x0c\r" for c in piece):
            continue
        pieces.append(piece)
        weight.append(1.0 / (10.0 - sp.get_score(i)))
    return pieces, np.array(weight), byte_at


class Lattice:
    """Piece lookup and the recursions, for many words at a time."""

    def __init__(self, pieces: list[str], byte_at: np.ndarray, log_p: np.ndarray):
        self.byte_at, self.log_p = byte_at, log_p
        self.n = len(pieces)
        skip = set(byte_at.tolist())
        self.longest = max(len(p) for i, p in enumerate(pieces) if i not in skip)
        self.table, self.ids = np.zeros(1 << _SLOT_BITS, dtype=np.uint64), np.full(1 << _SLOT_BITS, -1, dtype=np.int64)
        self.probes = 1
        for i, piece in enumerate(pieces):
            if i in skip:
                continue
            h = np.uint64(0)
            with np.errstate(over="ignore"):
                for c in piece:
                    h = h * _BASE + np.uint64(ord(c) + 1)
            slot, used = int((int(h) * int(_SPREAD) & (2**64 - 1)) >> (64 - _SLOT_BITS)), 1
            while self.ids[slot] >= 0:
                slot, used = (slot + 1) & ((1 << _SLOT_BITS) - 1), used + 1
            self.table[slot], self.ids[slot] = h, i
            self.probes = max(self.probes, used)

    def _find(self, h: np.ndarray) -> np.ndarray:
        slot = ((h * _SPREAD) >> np.uint64(64 - _SLOT_BITS)).astype(np.int64)
        out = np.full(h.shape, -1, dtype=np.int64)
        for k in range(self.probes):
            at = (slot + k) & ((1 << _SLOT_BITS) - 1)
            hit = (self.table[at] == h) & (self.ids[at] >= 0)
            out[hit] = self.ids[at[hit]]
        return out

    def _groups(self, words: list[bytes]):
        """(places, codes) of the words of each length; the first code is the mark."""
        text = b"\n".join(words).decode()
        codes = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32).astype(np.int64)
        ends = np.append(np.flatnonzero(codes == 10), len(codes))
        begins = np.append(0, ends[:-1] + 1)
        size = ends - begins
        order = np.argsort(size, kind="stable")
        cut = np.flatnonzero(np.diff(size[order])) + 1
        for same in np.split(order, cut):
            n = int(size[same[0]])
            rows = max(1, CELLS // (n + 1))
            for places in np.split(same, range(rows, len(same), rows)):
                block = codes[begins[places][:, None] + np.arange(n)[None, :]]
                block = np.where(block == MARK, _HIDDEN, block)
                yield places, np.concatenate([np.full((len(places), 1), MARK), block], axis=1)

    def _bytes(self, codes: np.ndarray):
        """Distinct codes, the place of each code among them and the log probability of spelling it in bytes."""
        distinct, inverse = np.unique(codes, return_inverse=True)
        spelled = [self._spell(int(c)) for c in distinct]
        log_b = np.array([self.log_p[self.byte_at[s]].sum() if len(s) else -np.inf for s in spelled])
        return spelled, inverse.reshape(codes.shape), log_b

    @staticmethod
    def _spell(code: int) -> np.ndarray:
        if code == MARK:
            return np.zeros(0, dtype=np.int64)
        return np.frombuffer(chr(MARK if code == _HIDDEN else code).encode(), dtype=np.uint8).astype(np.int64)

    def _edges(self, codes: np.ndarray):
        """For each length: piece at each start (or -1) and the log weight of the edge; the byte spelling apart."""
        rows, n = codes.shape
        code, h = (codes + 1).astype(np.uint64), np.zeros((rows, n + 1), dtype=np.uint64)
        ids, logs = [], []
        with np.errstate(over="ignore"):
            for size in range(1, min(n, self.longest) + 1):
                h = h[:, : n + 1 - size] * _BASE + code[:, size - 1 :]
                found = self._find(h)
                ids.append(found)
                logs.append(np.where(found >= 0, self.log_p[found], -np.inf))
        spelled, inverse, log_b = self._bytes(codes)
        byte = log_b[inverse]
        return ids, logs, byte, spelled, inverse

    @staticmethod
    def _sum(terms: list[np.ndarray]) -> np.ndarray:
        x = np.stack(terms)
        top = x.max(axis=0)
        safe = np.where(np.isfinite(top), top, 0.0)
        with np.errstate(divide="ignore"):
            return safe + np.log(np.exp(x - safe).sum(axis=0))

    def _forward(self, logs: list[np.ndarray], byte: np.ndarray) -> np.ndarray:
        rows, n = byte.shape
        a = np.full((rows, n + 1), -np.inf)
        a[:, 0] = 0
        for t in range(1, n + 1):
            a[:, t] = self._sum([a[:, t - 1] + byte[:, t - 1], *[a[:, t - k] + logs[k - 1][:, t - k] for k in range(1, min(t, len(logs)) + 1)]])
        return a

    def marginals(self, words: list[bytes]) -> np.ndarray:
        """Natural log of each word's probability, all segmentations summed."""
        out = np.zeros(len(words))
        for places, codes in self._groups(words):
            if codes.shape[1] > LONG:
                out[places] = [self._long(row) for row in codes]
                continue
            _, logs, byte, _, _ = self._edges(codes)
            out[places] = self._forward(logs, byte)[:, -1]
        return out

    def expected(self, words: list[bytes], counts: np.ndarray) -> np.ndarray:
        """Expected uses of each piece over words with these counts."""
        total = np.zeros(self.n)
        for places, codes in self._groups(words):
            if codes.shape[1] > LONG:
                for place, row in zip(places, codes, strict=True):
                    self._long(row, total, float(counts[place]))
                continue
            ids, logs, byte, spelled, inverse = self._edges(codes)
            a = self._forward(logs, byte)
            rows, n = codes.shape
            b = np.full((rows, n + 1), -np.inf)
            b[:, n] = 0
            for t in range(n - 1, -1, -1):
                b[:, t] = self._sum([byte[:, t] + b[:, t + 1], *[logs[k - 1][:, t] + b[:, t + k] for k in range(1, min(n - t, len(logs)) + 1)]])
            self._add_uses(total, (ids, logs, byte, spelled, inverse), a, b, np.log(counts[places])[:, None] - a[:, -1:])
        return total

    def _add_uses(self, total: np.ndarray, edges, a: np.ndarray, b: np.ndarray, base: np.ndarray) -> None:
        """Adds to total the expected uses of each piece on edges, from the forward and backward values at all their ends."""
        ids, logs, byte, spelled, inverse = edges
        for k, (found, log) in enumerate(zip(ids, logs, strict=True), 1):
            hit = found >= 0
            use = np.exp((a[:, : log.shape[1]] + log + b[:, k : k + log.shape[1]] + base)[hit])
            total += np.bincount(found[hit], weights=use, minlength=self.n)
        n = byte.shape[1]
        use = np.bincount(inverse.ravel(), weights=np.exp(a[:, :n] + byte + b[:, 1 : n + 1] + base).ravel(), minlength=len(spelled))
        for s, u in zip(spelled, use, strict=True):
            np.add.at(total, self.byte_at[s], u)

    def _part(self, codes: np.ndarray, at: int):
        """Edges that start in the LONG codes from at on, and for each start their (length, log weight)."""
        n = min(LONG, len(codes) - at)
        ids, logs, byte, spelled, inverse = self._edges(codes[None, at : at + n + self.longest - 1])
        ids, logs, byte, inverse = [x[:, :n] for x in ids], [x[:, :n] for x in logs], byte[:, :n], inverse[:, :n]
        steps: list[list[tuple[int, float]]] = [[] for _ in range(n)]
        for k, log in [(1, byte), *enumerate(logs, 1)]:
            starts = np.flatnonzero(np.isfinite(log[0]))
            for t, w in zip(starts.tolist(), log[0, starts].tolist(), strict=True):
                steps[t].append((k, w))
        return (ids, logs, byte, spelled, inverse), steps

    @staticmethod
    def _ahead(carried: list[float], steps: list[list[tuple[int, float]]]) -> list[float]:
        """Forward values of a part's places and of those that its edges reach, from what came before."""
        a = carried + [-math.inf] * len(steps)
        for t, edges in enumerate(steps):
            for k, w in edges:
                a[t + k] = _plus(a[t + k], a[t] + w)
        return a

    def _long(self, codes: np.ndarray, total: np.ndarray | None = None, count: float = 1.0) -> float:
        """Natural log of one long word's probability, walked in parts of LONG codes; with total, its expected uses are added to that.

        From part to part go the forward values of the next longest + 1 places; the way back meets each part's first ones again.
        """
        carried, kept, starts = [0.0] + [-math.inf] * self.longest, [], range(0, len(codes), LONG)
        for at in starts:
            kept.append(carried)
            _, steps = self._part(codes, at)
            carried = self._ahead(carried, steps)[len(steps) :]
        whole = carried[0]
        if total is not None:
            after = [0.0] + [-math.inf] * self.longest
            for at, first in zip(reversed(starts), reversed(kept), strict=True):
                edges, steps = self._part(codes, at)
                b = [-math.inf] * len(steps) + after
                for t in range(len(steps) - 1, -1, -1):
                    for k, w in steps[t]:
                        b[t] = _plus(b[t], b[t + k] + w)
                self._add_uses(total, edges, np.array([self._ahead(first, steps)]), np.array([b]), np.array([[math.log(count) - whole]]))
                after = b[: self.longest + 1]
        return whole


def _plus(x: float, y: float) -> float:
    """log(exp(x) + exp(y))"""
    if x < y:
        x, y = y, x
    return x if y == -math.inf else x + math.log1p(math.exp(y - x))


def _tokens(text: bytes | None) -> list[bytes]:
    return (text or b"").lower().split()


def count_words(docs: DataFrame, mod: int = 7, held: int = 2) -> DataFrame:
    """word, n (its count in training texts, 0 if it occurs in held-out ones only), summed within tasks."""

    def run(batches):
        seen: Counter = Counter()

        def flush():
            rows = pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], ["word", "n"])
            seen.clear()
            return rows

        for batch in batches:
            for text, train in zip(batch.column("text").cast(pa.binary()), batch.column("train").to_pylist(), strict=True):
                words = _tokens(text.as_py())
                if train:
                    seen.update(words)
                else:
                    for w in words:
                        if w not in seen:
                            seen[w] = 0
                if len(seen) > 400_000:
                    yield flush()
        yield flush()

    train = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % mod != held, F.lit(True))
    return docs.select("text", train.alias("train")).mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _many(batches, column: str, size: int = 100_000):
    """Words and counts of several batches together, up to about size words or CELLS bytes."""
    words, counts, held = [], [], 0
    for batch in batches:
        words += batch.column("word").to_pylist()
        counts.append(batch.column(column).to_numpy())
        held += batch.column("word").nbytes
        if len(words) >= size or held >= CELLS:
            yield words, np.concatenate(counts)
            words, counts, held = [], [], 0
    if words:
        yield words, np.concatenate(counts)


def expected_uses(counts: DataFrame, pieces: list[str], byte_at: np.ndarray, log_p: np.ndarray) -> np.ndarray:
    """One expectation step: a sum for each piece of the vocabulary, added up within tasks first."""

    def run(batches):
        lattice = Lattice(pieces, byte_at, log_p)
        total = np.zeros(lattice.n)
        for words, n in _many(batches, "n"):
            total += lattice.expected(words, n.astype(np.float64))
        use = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(use, pa.int64()), pa.array(total[use], pa.float64())], ["piece", "uses"])

    out = np.zeros(len(pieces))
    for row in counts.where("n > 0").select("word", "n").mapInArrow(run, "piece long, uses double").groupBy("piece").agg(F.sum("uses").alias("uses")).collect():
        out[row["piece"]] = row["uses"]
    return out


def fit(counts: DataFrame, ends: int, path: str = VOCABULARY, passes: int = PASSES) -> tuple[list[str], np.ndarray, np.ndarray, float]:
    """Pieces, byte places, log probabilities of the pieces, and that of the end."""
    pieces, weight, byte_at = load_pieces(path)
    log_p, log_end = np.log(weight / weight.sum() * 0.98), float(np.log(0.02))
    for _ in range(passes):
        uses = expected_uses(counts, pieces, byte_at, log_p)
        if not uses.sum():
            break
        total = uses.sum() + SMOOTH * len(pieces) + ends + SMOOTH
        log_p, log_end = np.log((uses + SMOOTH) / total), float(np.log((ends + SMOOTH) / total))
    return pieces, byte_at, log_p, log_end


def _frequent(weighed: DataFrame, head: int) -> DataFrame:
    """At most head words, the most frequent; words of nearly equal counts stand or fall together."""
    step = F.floor(F.log2(F.col("n") + 1.0) * 16)
    reach, least = 0, None
    for row in sorted(weighed.groupBy(step.alias("s")).count().collect(), key=lambda r: -r["s"]):
        reach += row["count"]
        if reach > head:
            break
        least = row["s"]
    return weighed.where(step >= least if least is not None else F.lit(False))


def score(docs: DataFrame, scratch: Scratch, mod: int = 7, held: int = 2, path: str = VOCABULARY, passes: int = PASSES, head: int = HEAD) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score."""
    counts = scratch.table(count_words(docs, mod, held))
    ends = docs.where(F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % mod != held, F.lit(True))).count()
    sums = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count_if(F.col("n") > 0).alias("v")).first()
    n_all, distinct = sums["n"] + ends, sums["v"] + (ends > 0)
    pieces, byte_at, log_p, log_end = fit(counts, ends, path, passes)

    def weigh(batches):
        lattice = Lattice(pieces, byte_at, log_p)
        for words, n in _many(batches, "n"):
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array(n, pa.int64()), pa.array(lattice.marginals(words) / _LN10, pa.float64())], ["word", "n", "log_m"])

    weighed = scratch.table(counts.mapInArrow(weigh, "word binary, n long, log_m double"))
    below = float(np.log10(n_all + distinct + 1))
    top = _frequent(weighed, head).collect()
    shared = docs.sparkSession.sparkContext.broadcast(([bytes(r["word"]) for r in top], np.array([r["n"] for r in top], dtype=np.int64), np.array([r["log_m"] for r in top])))

    def split(batches):
        words, n, log_m = shared.value
        place = {w: i for i, w in enumerate(words)}.get
        log_b = np.append(np.log10(n + 1.0) - below, 0.0)
        log_m, known = np.append(log_m, 0.0), np.append(n > 0, False)
        end_b, end_m = float(np.log10(ends + 1.0)) - below, log_end / _LN10
        none = len(words)
        for batch in batches:
            ids, out = zip(batch.column("row").to_pylist(), batch.column("doc_id").to_pylist(), strict=True), ([], [], [], [], [], [], [], [])
            for (row, doc), text in zip(ids, batch.column("text").cast(pa.binary()), strict=True):
                tokens = _tokens(text.as_py())
                at = np.fromiter((place(w, none) for w in tokens), dtype=np.int64, count=len(tokens))
                rest = Counter([tokens[i] for i in np.flatnonzero(at == none).tolist()])
                k = len(rest)
                for column, value, fill in zip(out, (row, doc, None, 1, len(tokens) + 1, int(known[at].sum()) + (ends > 0), log_b[at].sum() + end_b, log_m[at].sum() + end_m), ([row] * k, [None] * k, list(rest), list(rest.values()), [0] * k, [0] * k, [0.0] * k, [0.0] * k), strict=True):
                    column.append(value)
                    column.extend(fill)
            kinds = (pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds, strict=True)], ["row", "doc_id", "word", "k", "n_tokens", "n_known", "base_score", "score"])

    # a row's number is written once, with all its parts
    numbered = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    parts = numbered.mapInArrow(split, "row long, doc_id long, word binary, k long, n_tokens long, n_known long, base_score double, score double")
    parts = scratch.table(parts)
    heads = parts.where("word is null").select("row", "doc_id", "n_tokens", "n_known", "base_score", "score")
    k = F.col("k")
    tails = parts.where("word is not null").select("row", "word", "k").join(weighed, "word")
    tails = tails.select("row", F.lit(None).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("n_tokens"), F.when(F.col("n") > 0, k).otherwise(0).alias("n_known"), (k * (F.log10(F.col("n") + 1.0) - F.lit(below))).alias("base_score"), (k * F.col("log_m")).alias("score"))
    whole = heads.union(tails).groupBy("row").agg(F.max("doc_id").alias("doc_id"), *[F.sum(c).alias(c) for c in ("n_tokens", "n_known", "base_score", "score")])
    return whole.select("doc_id", "n_tokens", "n_known", F.lit(int(n_all)).cast("long").alias("train_tokens"), "base_score", "score")


def op4_lm_score(spark, sf_dir: str) -> DataFrame:
    out = score(read(spark, sf_dir, "documents"), Scratch(spark))
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2
    return out.select("doc_id", held.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
