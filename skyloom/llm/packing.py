"""Best-fit packing of tokenized documents, improved by swap-based local search.

Pieces are dealt round-robin over partitions and packed in chunks of a bounded
number of pieces, so no task holds more than one chunk and no key decides where
a piece goes. A chunk starts from best-fit decreasing. Then all underfull bins
hand their documents to fuller ones: by a move, a one-for-one exchange or a
two-for-one exchange either way, each of which raises the sum of squared fill,
until as few bins as can be are left or no two bins have an exchange left.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyloom.llm.common import kind, utf8
from skyloom.scratch import store

SIZE = 2048
CHUNK_PIECES = 16_384
#: Words whose ids a task keeps, bytes of a text that it tokenizes at a time, and letter-only words that it encodes as one line.
KNOWN_WORDS, BLOCK_BYTES, LINE_WORDS = 500_000, 1 << 20, 256
FINAL = re.compile(rb"([a-z])([.,])(?=[\x20\x09-\x0D]|$)")


def folded(text: bytes) -> list[bytes]:
    """Words in lower case, a final point or comma after a letter apart: the tokenizer ignores the one and does the other. A text with what may be a special token stays as it is."""
    return text.split() if b"<|" in text else FINAL.sub(rb"\1 \2", text.lower()).split()


class WordIds:
    """Token ids of white-space-separated words, which the tokenizer never joins, as little-endian 32-bit numbers."""

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.known = Tokenizer.from_file(path), {}
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for word, i in vocabulary.items() if word.endswith("</w>")]] = True

    def learn(self, lists: list[list[bytes]]) -> None:
        """Encode what these lists of words have that isn't known."""
        new = set().union(*lists).difference(self.known)
        if new and len(self.known) + len(new) > KNOWN_WORDS:
            self.known.clear()
            new = set().union(*lists)
        plain = [w for w in new if w.isalpha()]  # bytes: ASCII letters alone, which end with one end-of-word token
        rest = [w for w in new if not w.isalpha()]
        lines = [plain[i : i + LINE_WORDS] for i in range(0, len(plain), LINE_WORDS)]
        for line, found in zip(lines, self.encoded([b" ".join(x) for x in lines]), strict=True):
            end = np.nonzero(self.ends[found])[0] + 1
            if len(end) == len(line):
                data, at = found.tobytes(), 0
                for w, e in zip(line, (4 * end).tolist(), strict=True):
                    self.known[w], at = data[at:e], e
            else:
                rest += line
        self.known.update((w, x.tobytes()) for w, x in zip(rest, self.encoded(rest), strict=True))

    def encoded(self, texts: list[bytes]) -> list[np.ndarray]:
        return [np.array(e.ids, "<u4") for e in self.tokenizer.encode_batch_fast([t.decode("utf-8", "replace") for t in texts], add_special_tokens=False)]

    def __call__(self, words: list[bytes]) -> bytes:
        return b"".join(map(self.known.__getitem__, words))


_kept: dict[str, WordIds] = {}


def word_ids(path: str) -> WordIds:
    """The ids by a vocabulary file. A Python worker keeps those of the last file, with the words they know, for its next tasks."""
    if path not in _kept:
        _kept.clear()
        _kept[path] = WordIds(path)
    return _kept[path]


def blocks(text: bytes) -> Iterator[bytes]:
    """A text in blocks of a bounded size where it has spaces."""
    start = 0
    while len(text) - start > BLOCK_BYTES:
        end = max(text.rfind(s, start, start + BLOCK_BYTES) for s in (b" ", b"\n", b"\t"))
        if end <= start:
            end = min((e for s in (b" ", b"\n", b"\t") if (e := text.find(s, start + BLOCK_BYTES)) > 0), default=len(text))
        yield text[start:end]
        start = end
    yield text[start:]


def pieces_of(ids: Iterable[bytes], size: int) -> list[tuple[int, int, int]]:
    """Start, length and CRC-32 of a document's pieces, from its ids in parts; id 0 ends the document."""
    out, start, rest = [], 0, b""

    def cut(data: bytes, least: int) -> bytes:
        nonlocal start
        at = 0
        while len(data) - at >= least:
            part = data[at : at + 4 * size]
            out.append((start, len(part) // 4, zlib.crc32(part)))
            start, at = start + len(part) // 4, at + len(part)
        return data[at:]

    for part in ids:
        rest = cut(rest + part, 4 * size)
    cut(rest + bytes(4), 4)
    return out


def pieces_of_all(texts: Iterable[bytes], ids: WordIds, size: int) -> Iterator[list[tuple[int, int, int]]]:
    """Pieces of each text. Short texts are tokenized some at a time, a long one block by block."""

    def known(words: list[bytes]) -> bytes:
        ids.learn([words])
        return ids(words)

    held, total = [], 0

    def flush() -> Iterator[list[tuple[int, int, int]]]:
        ids.learn(held)
        yield from (pieces_of([ids(words)], size) for words in held)

    for text in texts:
        if held and total + len(text) > BLOCK_BYTES:
            yield from flush()
            held, total = [], 0
        if len(text) > BLOCK_BYTES:
            yield pieces_of((known(folded(b)) for b in blocks(text)), size)
        else:
            held.append(folded(text))
            total += len(text)
    yield from flush()


def tokenized(docs: DataFrame, tokenizer: str, size: int = SIZE, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 for each piece of each row."""
    plain = docs.select(F.col(doc_id).cast("string").alias("doc_id"), utf8(F.col(text)).alias("text"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids = word_ids(tokenizer)
        for batch in batches:
            found = pieces_of_all(map(bytes, batch["text"]), ids, size)
            rows = [(i, k, *p) for i, pieces in enumerate(found) for k, p in enumerate(pieces)]
            out = pd.DataFrame(rows, columns=["_i", "piece", "start", "length", "ids_crc32"])
            out.insert(0, "doc_id", batch["doc_id"].take(out["_i"]).to_numpy())
            yield out.drop(columns="_i")

    out = plain.mapInPandas(run, "doc_id string, piece int, start long, length long, ids_crc32 long")
    return out.withColumn("doc_id", F.col("doc_id").cast(kind(docs, doc_id)))


def best_fit(lengths: list[int], size: int) -> list[list[int]]:
    """Best-fit decreasing: the items of each bin. Bins wait in a list for each size of gap, and a bit set tells which lists hold any."""
    bins, waiting, gaps = [], [[] for _ in range(size + 1)], 0
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        need = lengths[i]
        fits = gaps >> need
        if fits:
            gap = need + (fits & -fits).bit_length() - 1
            b = waiting[gap].pop()
            if not waiting[gap]:
                gaps &= ~(1 << gap)
        else:
            gap, b = size, len(bins)
            bins.append([])
        bins[b].append(i)
        waiting[gap - need].append(b)
        gaps |= 1 << (gap - need)
    return bins


def swaps(kind: tuple[int, ...]) -> dict[int, tuple[int, ...]]:
    """Weights of one or two items of a bin, each with the fewest items that have it."""
    values = sorted(set(kind))
    found = {x: (x,) for x in values}
    for n, x in enumerate(values):
        for y in values[n if kind.count(x) > 1 else n + 1 :]:
            found.setdefault(x + y, (x, y))
    return found


class Kinds:
    """Bins by their items' lengths: how many of each kind there are, and what each underfull kind can take.

    An entry is a weight that a kind may give back, 0 included, with the most that
    it may get for it. A kind's `seen` tells up to which entry it found nothing.
    """

    def __init__(self, size: int):
        self.size, self.numbers = size, {}
        self.names: list[tuple[int, ...]] = []
        self.fills: list[int] = []
        self.swaps: list[dict[int, tuple[int, ...]]] = []
        self.seen: list[int] = []
        self.counts = np.zeros(1 << 10, np.int64)
        self.n, self.data = 0, np.empty((5, 1 << 12), np.int64)

    def put(self, kind: tuple[int, ...], n: int) -> int:
        """Add bins of a kind. Its entries are made again where a kind may have passed them: while it had no bins, or one bin beside itself."""
        k = self.numbers.setdefault(kind, len(self.names))
        if k == len(self.names):
            self.names.append(kind)
            self.fills.append(sum(kind))
            self.swaps.append(swaps(kind) if self.fills[k] < self.size else {})
            self.seen.append(0)
            if k == len(self.counts):
                self.counts = np.concatenate([self.counts, np.zeros_like(self.counts)])
        if self.counts[k] < 2 and self.fills[k] < self.size:
            fill = self.fills[k]
            more = [(v, v + self.size - fill, k, len(t), fill) for v, t in [(0, ()), *self.swaps[k].items()]]
            while self.n + len(more) > self.data.shape[1]:
                self.data = np.concatenate([self.data, np.empty_like(self.data)], axis=1)
            self.data[:, self.n : self.n + len(more)] = np.array(more, np.int64).T
            self.n += len(more)
        self.counts[k] += n
        return k

    def tidy(self) -> None:
        """Drop entries of kinds without bins, if these are most."""
        live = self.counts[self.data[2, : self.n]] > 0
        if 2 * live.sum() < self.n:
            before = np.concatenate([[0], live.cumsum()])
            self.seen = [int(before[x]) for x in self.seen]
            self.n, self.data = int(live.sum()), self.data[:, : self.n][:, live]

    def best(self, s: int) -> tuple[int, tuple[int, ...], tuple[int, ...]] | None:
        """The exchange by which a bin as full or fuller gains most from one of kind `s`, among entries not seen: its kind, what it gets and what it gives back."""
        data = self.data[:, self.seen[s] : self.n]
        data = data[:, (data[4] >= self.fills[s]) & (self.counts[data[2]] > (data[2] == s))]
        low, high, number, items, _ = data
        gained, found = 0, None
        for w, give in self.swaps[s].items() if len(low) else ():
            gain = np.where((low < w) & (w <= high) & (items + len(give) <= 3), w - low, 0)
            if gain[at := int(gain.argmax())] > gained:
                gained, found = int(gain[at]), (at, give)
        if not found:
            return None
        k, v = int(number[found[0]]), int(low[found[0]])
        return k, found[1], self.swaps[k][v] if v else ()


def replaced(kind: tuple[int, ...], out: tuple[int, ...], into: tuple[int, ...]) -> tuple[int, ...]:
    """A bin's lengths after an exchange."""
    rest = list(kind)
    for x in out:
        rest.remove(x)
    return tuple(sorted([*rest, *into]))


def improve(bins: list[list[int]], lengths: list[int], size: int) -> list[list[int]]:
    """Local search over all underfull bins of a chunk: ends at the lower bound, or when no two bins have an exchange left.

    Bins of equal lengths are one kind and take a step together; kinds are held
    against each other once. By a step a bin gains from one that is no fuller: the
    squared fill grows, so it ends.
    """
    least, left = -(-sum(lengths) // size), len(bins)
    if left <= least:
        return bins
    kinds = Kinds(size)
    for kind, n in Counter(tuple(sorted(lengths[i] for i in b)) for b in bins).items():
        kinds.put(kind, n)
    changed = True
    while changed and left > least:
        changed = False
        kinds.tidy()
        for s in sorted(range(len(kinds.names)), key=lambda k: (kinds.fills[k], k)):
            while kinds.names[s] and kinds.counts[s] and kinds.seen[s] < kinds.n and left > least:
                if not (step := kinds.best(s)):
                    kinds.seen[s] = kinds.n
                    break
                target, give, take = step
                kind, fuller = replaced(kinds.names[s], give, take), replaced(kinds.names[target], take, give)
                n = int(kinds.counts[s] // 2 if target == s else min(kinds.counts[s], kinds.counts[target]))
                n = n if kind else min(n, left - least)
                kinds.counts[s] -= n
                kinds.counts[target] -= n
                kinds.put(fuller, n)
                changed = True
                if kind:
                    s = kinds.put(kind, n)
                else:
                    left -= n
    items: dict[int, list[int]] = {}
    for i, x in enumerate(lengths):
        items.setdefault(x, []).append(i)
    return [[items[x].pop() for x in kind] for kind, n in zip(kinds.names, kinds.counts.tolist()) for _ in range(n)]


def pack(pieces: DataFrame, size: int = SIZE) -> DataFrame:
    """All columns of `pieces` (stored; with `length` from 1 to size), sequence_id and offset.

    All underfull bins of a chunk are searched; a piece is never left out, whatever
    the search finds. Equal rows are pieces of their own. No rows give no rows.
    """
    n, types = max(1, -(-pieces.count() // CHUNK_PIECES)), dict(pieces.dtypes)
    # Ids travel as text, which pandas keeps exact beside nulls.
    dealt = pieces.withColumn("doc_id", F.col("doc_id").cast("string")).repartition(n)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sequence, held = TaskContext.get().partitionId() << 40, []

        def packed(chunk: pd.DataFrame) -> pd.DataFrame:
            nonlocal sequence
            lengths = chunk["length"].tolist()
            number, offset = [0] * len(lengths), [0] * len(lengths)
            for b in improve(best_fit(lengths, size), lengths, size):
                at = 0
                for i in b:
                    number[i], offset[i], at = sequence, at, at + lengths[i]
                sequence += 1
            return chunk.assign(sequence_id=number, offset=offset)

        for batch in batches:
            held.append(batch)
            while sum(map(len, held)) >= 2 * CHUNK_PIECES:
                rows = pd.concat(held, ignore_index=True)
                held = [rows.iloc[CHUNK_PIECES:].reset_index(drop=True)]
                yield packed(rows.iloc[:CHUNK_PIECES].reset_index(drop=True))
        if held:
            yield packed(pd.concat(held, ignore_index=True))

    out = dealt.mapInPandas(run, ", ".join(f"`{c}` {t}" for c, t in dealt.dtypes) + ", sequence_id long, offset long")
    return out.withColumn("doc_id", F.col("doc_id").cast(types["doc_id"]))


def pack_documents(docs: DataFrame, tokenizer: str, size: int = SIZE, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: every document in sequences of at most `size` tokens.

    A null or empty text is the end token alone. Texts of any length are cut into
    pieces of `size` tokens. Rows that repeat are documents of their own. Columns
    beside the two named are not looked at. No rows give no rows.
    """
    return pack(store(tokenized(docs, tokenizer, size, doc_id, text), "pieces"), size)
