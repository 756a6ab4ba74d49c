"""Operator 10, byte-level BPE by prefix-sharing trie traversal.

The distinct words of a batch form a trie.  A depth-first walk (over the sorted words, with
a stack that holds the path) carries for every prefix the last token of that prefix's
encoding; a prefix that several words share is computed once.  The encoding of a word is
read off backwards through these last tokens.  A token t ends the encoding of a prefix
exactly when the rest's own last token and t stay apart under the merge rules, which
``Bpe.apart`` decides by undoing merges from both sides of their border.

Encoding and decoding agree with the tokenizers library for files with a byte-level
pre-tokeniser and merges in id order (checked on loading).  The vocabulary file is read on
the driver by a path that is a parameter, and is sent once to the executors; its size is
that of the file.  Words seen before are kept in a table of bounded size.

Defined cases: null counts as empty and gives no ids; texts of any length are encoded
whole; each input row gives one row, repeated rows and null ids too; an empty table gives
an empty result; other columns do not matter.  Strings of added tokens in a text become
those tokens, as the library does by default.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from lattiq.llm.common import documents, rows_of, tune

PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
KNOWN_WORDS = 700_000


def byte_symbols() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Bpe:
    """Tables and caches of one vocabulary, built from the parsed JSON of a tokenizers file."""

    def __init__(self, spec: dict) -> None:
        import regex

        kind = spec["pre_tokenizer"]
        if spec["model"]["type"] != "BPE" or kind["type"] != "ByteLevel" or kind["add_prefix_space"] or spec["normalizer"]:
            raise ValueError("only byte-level BPE files without a normaliser are read")
        symbols = byte_symbols()
        as_bytes = lambda s: bytes(symbols[c] for c in s)
        vocab = {as_bytes(s): i for s, i in spec["model"]["vocab"].items()}
        self.ids, self.bytes = vocab, {i: s for s, i in vocab.items()}
        self.pair, self.parts = {}, {i: (i, i) for s, i in vocab.items() if len(s) == 1}
        last = -1
        for merge in spec["model"]["merges"]:
            a, b = merge if isinstance(merge, list) else merge.split(" ")
            a, b = as_bytes(a), as_bytes(b)
            i = vocab[a + b]
            if i <= last:
                raise ValueError("merges are not in the order of their ids")
            last = i
            self.pair[vocab[a], vocab[b]] = i
            self.parts[i] = (vocab[a], vocab[b])
        self.suffix_tokens()
        self.find = regex.compile(PATTERN).findall
        # the same pattern for ASCII texts, which the standard library matches faster
        self.find_ascii = re.compile(PATTERN.replace(r"[^\s\p{L}\p{N}]", r"[^ \t-\rA-Za-z0-9]").replace(r"\p{L}", "[A-Za-z]").replace(r"\p{N}", "[0-9]").replace(r"\s", r"[ \t-\r]").replace(r"\S", r"[^ \t-\r]")).findall
        added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.added = {s: i.to_bytes(4, "little") for s, i in added.items()}
        self.bytes |= {i: s.encode() for s, i in added.items()}
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")") if added else None
        top = max(self.bytes) + 1
        self.as_id = [i.to_bytes(4, "little") for i in range(top)]
        pieces = [self.bytes.get(i, b"") for i in range(top)]
        self.blob = np.frombuffer(b"".join(pieces), np.uint8)
        self.sizes = np.array(list(map(len, pieces)))
        self.places = np.cumsum(self.sizes) - self.sizes
        self.known: dict[str, bytes] = {}
        self.apart_known: dict[int, bool] = {}

    def apart(self, left: int, right: int) -> bool:
        """Whether left and right, side by side, are the encoding of their joined bytes."""
        key = left << 32 | right
        if (known := self.apart_known.get(key)) is None:
            if len(self.apart_known) >= KNOWN_WORDS:
                self.apart_known.clear()
            known = self.apart_known[key] = self._apart(left, right)
        return known

    def _apart(self, left: int, right: int) -> bool:
        before = 1 << 62  # a merge over the border counts if it comes before the merge just undone
        while True:
            if self.pair.get((left, right), before) < before:
                return False
            # undo the later merge, on whichever side of the border it lies (the left one on a tie goes last)
            l_parts, r_parts = self.parts[left], self.parts[right]
            l_open, r_open = l_parts[0] != left, r_parts[0] != right
            if l_open and (left > right or not r_open):
                before, left = left, l_parts[1]
            elif r_open:
                before, right = right + 1, r_parts[0]
            else:
                return True

    def suffix_tokens(self) -> None:
        """An automaton over the vocabulary: from a state and a byte to the next state, and
        for each state the tokens (with widths, longest first) that end there."""
        child: list[dict[int, int]] = [{}]
        own: dict[int, tuple[int, int]] = {}
        for data, token in self.ids.items():
            node = 0
            for byte in data:
                nxt = child[node].get(byte)
                if nxt is None:
                    nxt = child[node][byte] = len(child)
                    child.append({})
                node = nxt
            own[node] = (token, len(data))
        back, ends = [0] * len(child), [()] * len(child)
        level = [0]
        while level:
            below = []
            for node in level:
                for byte, nxt in child[node].items():
                    at = back[node]
                    while at and byte not in child[at]:
                        at = back[at]
                    back[nxt] = child[at][byte] if node else 0
                    ends[nxt] = ((own[nxt],) if nxt in own else ()) + ends[back[nxt]]
                    below.append(nxt)
            level = below
        self.child, self.back, self.ends, self.moves = child, back, ends, {}

    def step(self, at: int, byte: int) -> int:
        while at and byte not in self.child[at]:
            at = self.back[at]
        return self.child[at].get(byte, 0)

    def learn(self, words: list[str]) -> None:
        """Encode words that are not known yet: depth first through the trie of their bytes."""
        ends, moves, apart, known_pair, as_id, known = self.ends, self.moves, self.apart, self.apart_known, self.as_id, self.known
        path = b""
        state: list[int] = [0]  # state[i]: the automaton's state after path[:i]
        last: list[int] = [-1]  # last[i]: the last token of the encoding of path[:i]
        width: list[int] = [0]
        for data, word in sorted((w.encode(), w) for w in words):
            shared, most = 0, min(len(path), len(data))
            while shared < most and path[shared] == data[shared]:
                shared += 1
            del state[shared + 1 :], last[shared + 1 :], width[shared + 1 :]
            at = state[shared]
            for end in range(shared + 1, len(data) + 1):
                move = at << 8 | data[end - 1]
                at = moves.get(move)
                if at is None:
                    at = moves[move] = self.step(move >> 8, move & 255)
                for token, n in ends[at]:
                    if n == end:
                        break
                    good = known_pair.get(last[end - n] << 32 | token)
                    if good is None:
                        good = apart(last[end - n], token)
                    if good:
                        break
                state.append(at)
                last.append(token)
                width.append(n)
            path, out, at = data, [], len(data)
            while at:
                out.append(as_id[last[at]])
                at -= width[at]
            out.reverse()
            known[word] = b"".join(out)

    def words(self, text: str) -> list[str]:
        if self.cut is None or not self.cut.search(text):
            return self.find_ascii(text) if text.isascii() else self.find(text)
        out = []
        for part in self.cut.split(text):
            out += [part] if part in self.added else self.find(part)
        return out

    def encode_batch(self, texts: list[str]) -> Iterator[bytes]:
        """The ids of each text as little-endian 32-bit integers."""
        if len(self.known) > KNOWN_WORDS:
            self.known = {}
        if not self.known:
            self.known.update(self.added)
        cut = [self.words(t) for t in texts]
        self.learn(list(set().union(*cut) - self.known.keys()))
        known = self.known.__getitem__
        for words in cut:
            yield b"".join(map(known, words))

    def decode(self, ids: bytes) -> str:
        token = np.frombuffer(ids, "<u4")
        size = self.sizes[token]
        shift = self.places[token] - (np.cumsum(size) - size)
        return self.blob[np.repeat(shift, size) + np.arange(int(size.sum()))].tobytes().decode("utf-8", "replace")


def load(path: str) -> dict:
    with open(path, encoding="utf-8") as f:
        return json.load(f)


def bpe_digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """One row per document: id, n_tokens, ids_sha256, decoded_sha256, and the ids if asked for."""
    spark = docs.sparkSession
    tune(spark)
    shared = spark.sparkContext.broadcast({"spec": load(path)})

    def encode(batches):
        tables = shared.value  # one object for all tasks of a Python worker
        bpe = tables["bpe"] = tables.get("bpe") or Bpe(tables["spec"])
        for rows in rows_of(batches, "id", "text"):
            for at in range(0, len(rows), 256):  # so that the words in hand stay few
                part = rows[at : at + 256]
                out = []
                for (key, _), ids in zip(part, bpe.encode_batch([t or "" for _, t in part]), strict=True):
                    decoded = hashlib.sha256(bpe.decode(ids).encode()).hexdigest()
                    out.append((key, len(ids) // 4, hashlib.sha256(ids).hexdigest(), decoded, memoryview(ids).cast("I").tolist() if with_ids else None))
                cols = list(zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.string()), pa.array(cols[3], pa.string()), pa.array(cols[4], pa.list_(pa.int64()))], names=["id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"])

    out = docs.selectExpr(f"cast(`{id_col}` as long) as id", f"`{text_col}` as text").mapInArrow(encode, "id long, n_tokens long, ids_sha256 string, decoded_sha256 string, ids array<long>")
    return out.selectExpr(f"id as `{id_col}`", "n_tokens", "ids_sha256", "decoded_sha256", *(["ids"] if with_ids else []))


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_digests(documents(spark, sf_dir), default_path())
