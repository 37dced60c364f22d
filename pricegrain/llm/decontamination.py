"""Benchmark decontamination by pigeonhole edit matching.

Texts are compared after lower-casing and joining their words by one space. A test item of n characters may have up to
k = max(1, floor(n * 5 / 100)) edits. It is cut into k + 1 pieces; k edits leave at least one piece whole, so each passage within
k edits holds an exact hit of a piece. All pieces of a block of items are searched at once (Aho-Corasick); around each
hit the item's distance to the best substring is computed with Myers' bit-parallel algorithm on integers of n bits. An item of
fewer than SHORT characters may have no edits and must be whole words of the document: a few letters, or a letter more or
less, occur everywhere.

Items are broadcast in blocks of at most BLOCK_CHARS characters, so what a task holds is bounded however many items there
are; each block is searched in all documents, its matches are written, and its broadcast is released.

Defined cases: null or empty documents hold no item; items without words are not searched; rows that repeat are rows of their
own, and rows are judged by their own text alone, so ids may be null or repeat; equal items give a match each; an empty
table of items gives documents without matches; columns besides doc_id, text, item_id and text are not read, and kept
whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NARROW, Scratch, read

PER_CENT = 5
SHORT = 40
BLOCK_CHARS = 4_000_000


def normal(text: str | None) -> str:
    """The words, lower-case, joined by one space."""
    return b" ".join((text or "").lower().encode().split()).decode()


def budget(item: str, per_cent: int = PER_CENT) -> int:
    return max(1, len(item) * per_cent // 100) if len(item) >= SHORT else 0


def whole_words(item: str, text: str) -> bool:
    """Whether item is in text between spaces or ends."""
    return f" {item} " in f" {text} "


def pieces(item: str, k: int) -> list[tuple[int, str]]:
    """item in k + 1 pieces of nearly equal length, with their places."""
    cuts = [len(item) * i // (k + 1) for i in range(k + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def best_distance(item: str, text: str) -> int:
    """Smallest number of insertions, deletions and replacements that turn item into a substring of text (Myers 1999)."""
    n, where = len(item), {}
    for i, c in enumerate(item):
        where[c] = where.get(c, 0) | (1 << i)
    mask, top = (1 << n) - 1, 1 << (n - 1)
    up, down, score = mask, 0, n
    best = n
    for c in text:
        eq = where.get(c, 0)
        x = (((eq & up) + up) ^ up) | eq | down
        rise, fall = down | (mask & ~(x | up)), up & x
        if rise & top:
            score += 1
        elif fall & top:
            score -= 1
        rise, fall = (rise << 1) & mask, (fall << 1) & mask  # a match may begin anywhere: nothing enters at the first row
        vertical = eq | down
        up, down = fall | (mask & ~(vertical | rise)), rise & vertical
        best = min(best, score)
    return best


def blocks(items: DataFrame, limit: int = BLOCK_CHARS) -> Iterator[list[tuple[int, str]]]:
    """The items, normalised, in blocks of at most limit characters; the driver holds one block at a time."""
    block, size = [], 0
    for row in items.select("item_id", "text").toLocalIterator():
        text = normal(row["text"])
        if not text:
            continue
        if block and size + len(text) > limit:
            yield block
            block, size = [], 0
        block.append((row["item_id"], text))
        size += len(text)
    if block:
        yield block


def find(docs: DataFrame, block, per_cent: int = PER_CENT) -> DataFrame:
    """(doc_id, h1, h2, item_id, distance) of each item of the block (a broadcast) within its budget of edits in a document; h1, h2: hashes of the document's text."""

    def run(batches):
        import ahocorasick

        found = block.value
        by_piece: dict[str, list[tuple[int, int]]] = {}
        for i, (_, item) in enumerate(found):
            for place, piece in pieces(item, budget(item, per_cent)):
                by_piece.setdefault(piece, []).append((i, place))
        machine = ahocorasick.Automaton()
        for piece, at in by_piece.items():
            machine.add_word(piece, (len(piece), at))
        machine.make_automaton()
        for batch in batches:
            out: list[tuple] = []
            for k, text in enumerate(batch.column("text").to_pylist()):
                if not text:
                    continue
                text = normal(text)
                regions: dict[int, list[list[int]]] = {}
                for end, (size, at) in machine.iter(text):
                    for i, place in at:
                        item = found[i][1]
                        slack = budget(item, per_cent)
                        begin = end + 1 - size - place
                        spans = regions.setdefault(i, [])
                        a, b = max(0, begin - slack), begin + len(item) + slack
                        if spans and a <= spans[-1][1]:
                            spans[-1][1] = max(b, spans[-1][1])
                            spans[-1][0] = min(a, spans[-1][0])
                        else:
                            spans.append([a, b])
                for i, spans in regions.items():
                    item = found[i][1]
                    if len(item) < SHORT:
                        if whole_words(item, text):
                            out.append((k, found[i][0], 0))
                        continue
                    distance = len(item)
                    for a, b in spans:
                        part = text[a:b]
                        distance = min(distance, 0 if item in part else best_distance(item, part))
                        if not distance:
                            break
                    if distance <= budget(item, per_cent):
                        out.append((k, found[i][0], distance))
            own = batch.select(["doc_id", "h1", "h2"]).take(pa.array([x[0] for x in out], pa.int64()))
            more = [pa.array([x[n] for x in out], pa.int64()) for n in (1, 2)]
            yield pa.RecordBatch.from_arrays([own.column("doc_id").cast(pa.int64()), own.column("h1"), own.column("h2"), *more], ["doc_id", "h1", "h2", "item_id", "distance"])

    named = docs.select("doc_id", "text", F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(1), "text").alias("h2"))
    return named.mapInArrow(run, FOUND)


FOUND = "doc_id long, h1 long, h2 long, item_id long, distance long"


def matches(docs: DataFrame, items: DataFrame, scratch: Scratch, per_cent: int = PER_CENT) -> DataFrame:
    """(doc_id, h1, h2, item_id, distance) over all items: a scan of docs for each block of items."""
    out = docs.sparkSession.createDataFrame([], FOUND)
    for k, block in enumerate(blocks(items)):
        shared = docs.sparkSession.sparkContext.broadcast(block)
        found = scratch.table(find(docs, shared, per_cent), NARROW)
        shared.destroy()
        out = found if k == 0 else out.union(found)
    return out


def decontaminate(docs: DataFrame, items: DataFrame, scratch: Scratch, per_cent: int = PER_CENT) -> DataFrame:
    """The documents whose text holds no test item, with all their columns."""
    hit = matches(docs, items, scratch, per_cent).select("h1", "h2").distinct()
    own = docs.select(F.struct("*").alias("doc"), F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(1), "text").alias("h2"))
    return own.join(hit, ["h1", "h2"], "left_anti").select(*[F.col("doc")[c].alias(c) for c in docs.columns])


def op7_decontamination(spark, sf_dir: str) -> DataFrame:
    """(doc_id, item_id, distance): each test item found in a document, with its edit distance to the passage."""
    found = matches(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"), Scratch(spark))
    return found.select("doc_id", "item_id", "distance").distinct()
