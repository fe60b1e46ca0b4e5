"""Hierarchical multi-length packing of token ids into sequences.

Documents are routed to the smallest context tier that holds them (what is longer gives
whole sequences of the longest tier first).  Each tier is filled in arrival order; a
document that meets the end of a sequence is cut there, so a closed sequence has exactly
its tier's length and needs no padding.  At the end of a task the open sequences are
merged: the gap of a longer window is filled from the shorter tiers, which leaves one
unfinished sequence a task.  Every tier's sequences form step groups of equal tokens.

A task packs what it reads, so neither texts nor ids are shuffled, and a lost task gives
the same pieces when it runs again.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from textmill.llm.runtime import map_batches

TIERS = (512, 1024, 2048, 4096)
#: Tokens of a step group; each tier gives STEP_TOKENS / tier sequences to a group.
STEP_TOKENS = 1 << 16
END_ID = 2
#: Distinct chunks of text whose ids a worker remembers; it then starts afresh.
REMEMBERED = 500_000
#: Sequence numbers of a task.
TASK_SHIFT = 34

#: What str.split() takes for white space beyond the tokenizer's own, and runs without the latter.
_ODD = re.compile("[\x1c-\x1f]")
#: A full stop or comma after a Latin letter or digit begins a token, so a blank before it changes no ids.  (Not so after
#: the dotted capital I and some letters of other scripts: normalised, they end in a combining mark, which joins what follows.)
_MARK = re.compile("(?<=[0-9A-Za-zÀ-ÖØ-öø-įı-ɏ])([.,])")
_CHUNK = re.compile("[^\x09-\x0d \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")

PIECES = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, "
    "tier int, step_group long"
)


class ChunkTokenizer:
    """Token ids of texts, where white space ends a token: chunks between white space are looked up or encoded once."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.word_end = np.zeros(self.tokenizer.get_vocab_size() + 1, dtype=bool)
        for token, i in self.tokenizer.get_vocab().items():
            self.word_end[i] = token.endswith("</w>")
        self.forget()

    def forget(self) -> None:
        self.number: dict[str, int] = {}
        self.lengths = np.zeros(1 << 16, dtype=np.int64)
        self.begins = np.zeros(1 << 16, dtype=np.int64)
        self.ids = np.zeros(1 << 18, dtype=np.uint32)
        self.used = 0

    def _encoded(self, cores: list[str]) -> list[list[int]]:
        """Ids of chunks; words of letters alone are encoded many at a time and told apart by their word ends."""
        words = [c for c in cores if c.isalpha()]
        others = [c for c in cores if not c.isalpha()]
        lines = [words[i : i + 256] for i in range(0, len(words), 256)]
        found: dict[str, list[int]] = {}
        for line, enc in zip(lines, self.tokenizer.encode_batch_fast([" ".join(x) for x in lines], add_special_tokens=False), strict=True):
            ids = enc.ids
            ends = (np.flatnonzero(self.word_end[ids]) + 1).tolist()
            if len(ends) == len(line):
                found.update((w, ids[i:j]) for w, i, j in zip(line, [0, *ends], ends, strict=False))
            else:
                others += line
        found.update(zip(others, (e.ids for e in self.tokenizer.encode_batch_fast(others, add_special_tokens=False)), strict=True))
        return [found[c] for c in cores]

    def _remember(self, chunks: list[str], found: list[list[int]]) -> None:
        at, used = len(self.number), self.used
        lengths = np.array([len(x) for x in found], dtype=np.int64)
        ids = np.array([i for x in found for i in x], dtype=np.uint32)
        if at + len(found) > len(self.lengths):
            self.lengths, self.begins = (np.resize(x, 2 * (at + len(found))) for x in (self.lengths, self.begins))
        if used + len(ids) > len(self.ids):
            self.ids = np.resize(self.ids, 2 * (used + len(ids)))
        self.lengths[at : at + len(found)] = lengths
        self.begins[at : at + len(found)] = used + np.cumsum(lengths) - lengths
        self.ids[used : used + len(ids)] = ids
        self.used = used + len(ids)
        self.number.update(zip(chunks, range(at, at + len(found)), strict=True))

    def _looked_up(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The number of each chunk, and where each text's chunks end; the new chunks of all are encoded together."""
        chunks: list[str] = []
        counts = np.zeros(len(texts) + 1, dtype=np.int64)
        for k, text in enumerate(texts, 1):
            if text.isascii():
                text = text.lower()
            text = _MARK.sub(r" \1", text)
            chunks += text.split() if _ODD.search(text) is None else _CHUNK.findall(text)
            counts[k] = len(chunks)
        new = set(chunks).difference(self.number)
        if len(self.number) + len(new) > REMEMBERED:
            self.forget()
            new = set(chunks)
        if new:
            found = list(new)
            self._remember(found, self._encoded(found))
        return np.fromiter(map(self.number.__getitem__, chunks), np.int64, len(chunks)), counts

    def count(self, texts: list[str]) -> np.ndarray:
        """The number of ids of each text."""
        at, counts = self._looked_up(texts)
        return np.diff(np.concatenate([[0], np.cumsum(self.lengths[at])])[counts])

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text."""
        at, counts = self._looked_up(texts)
        lengths = self.lengths[at]
        ends = np.concatenate([[0], np.cumsum(lengths)])
        ids = self.ids[np.repeat(self.begins[at] - ends[:-1], lengths) + np.arange(ends[-1])]
        return np.split(ids, ends[counts[1:-1]]) if texts else []


_tokenizers: dict[str, ChunkTokenizer] = {}


def tokenizer(path: str) -> ChunkTokenizer:
    """One tokenizer for each worker and vocabulary file."""
    if path not in _tokenizers:
        _tokenizers[path] = ChunkTokenizer(path)
    return _tokenizers[path]


class _Packer:
    """Sequences of one task."""

    def __init__(self, task: int, tiers: tuple[int, ...], step_tokens: int):
        self.base, self.tiers, self.step_tokens = task << TASK_SHIFT, tiers, step_tokens
        self.opened, self.closed = 0, dict.fromkeys(tiers, 0)
        self.open: dict[int, list] = {}
        self.out: list[tuple] = []

    def _close(self, tier: int, pieces: list, finished: bool = True) -> None:
        sequence, self.opened = self.base + self.opened, self.opened + 1
        group = self.base + (self.tiers.index(tier) << (TASK_SHIFT - 3)) + self.closed[tier] // max(1, self.step_tokens // tier)
        self.closed[tier] += finished
        offset = 0
        for doc, start, ids, total in pieces:
            crc = zlib.crc32(ids.astype("<u4").tobytes())
            self.out.append((doc, start, len(ids), crc, total, sequence, offset, tier, group if finished else None))
            offset += len(ids)

    def _put(self, tier: int, doc, start: int, ids: np.ndarray, total: int) -> None:
        """Append to the tier's open sequence; cut at its end."""
        while len(ids):
            pieces, fill = self.open.get(tier, ([], 0))
            part, ids = ids[: tier - fill], ids[tier - fill :]
            pieces.append((doc, start, part, total))
            start, fill = start + len(part), fill + len(part)
            self.open[tier] = (pieces, fill)
            if fill == tier:
                self._close(tier, self.open.pop(tier)[0])

    def add(self, doc, ids: np.ndarray) -> None:
        total, start, longest = len(ids), 0, self.tiers[-1]
        while total - start >= longest:
            self._close(longest, [(doc, start, ids[start : start + longest], total)])
            start += longest
        if start < total:
            tier = next(t for t in self.tiers if total - start <= t)
            self._put(tier, doc, start, ids[start:], total)

    def finish(self) -> None:
        """Fill the longest open window from the shorter tiers, longest first; what is left is one unfinished sequence."""
        longest = self.tiers[-1]
        for tier in reversed(self.tiers[:-1]):
            for doc, start, ids, total in self.open.pop(tier, ([], 0))[0]:
                self._put(longest, doc, start, ids, total)
        if longest in self.open:
            self._close(longest, self.open.pop(longest)[0], finished=False)


def pack(
    docs: DataFrame, tokenizer_path: str, *, tiers: tuple[int, ...] = TIERS, step_tokens: int = STEP_TOKENS, end_id: int = END_ID
) -> DataFrame:
    """One row for each piece of a document in a sequence.

    docs needs doc_id (long) and text; other columns are ignored.  A document's ids are
    the tokenizer's for its whole text, then end_id, so a null or empty text has one id.
    A very long text gives as many pieces as it needs.  Repeated rows and equal doc_ids
    are packed one by one.  An empty table gives no rows.  doc_tokens counts the end id.
    step_group is null for the unfinished sequence that each task may have; every other
    group of a tier holds step_tokens tokens, but for the last of a task.

    The ids are those of the whole text only for tokenizers whose tokens end at white
    space, such as word_bpe_49k.json; others need their own chunking.
    """
    kinds = [f.strip().rsplit(" ", 1) for f in PIECES.split(",")]
    schema = pa.schema([(n, {"long": pa.int64(), "int": pa.int32()}[k]) for n, k in kinds])

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = tokenizer(tokenizer_path)
        packer = _Packer(TaskContext.get().partitionId(), tiers, step_tokens)

        def rows() -> pa.RecordBatch:
            out, packer.out = packer.out, []
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            for doc, ids in zip(batch.column("doc_id").to_pylist(), encoder.encode(texts), strict=True):
                packer.add(doc, np.append(ids, np.uint32(end_id)))
                if len(packer.out) >= 20_000:
                    yield rows()
        packer.finish()
        if packer.out:
            yield rows()

    return docs.select("doc_id", "text").transform(map_batches, pieces, PIECES)
