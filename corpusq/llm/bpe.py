"""BPE encoding and decoding with forced-boundary splitting.

A pair of adjacent bytes that occurs inside no vocabulary token can never be covered by one token,
so a cut between them is certain: merges on its two sides never interact. Texts are cut at such
pairs, distinct fragments are encoded once each and independently, and their ids are concatenated.

The vocabulary's split pattern looks at neighbours too, so a certain pair is used only where the
pattern gives the same pieces on both sides of the cut:

* the right byte starts a character;
* the left byte is no white space unless the right one is (a run of spaces gives its last space to
  the word that follows), and no last byte of a multi-byte space character;
* an apostrophe on the right follows an ASCII letter or digit (after another mark it belongs to that
  mark's run, while at a fragment's start it could begin a contraction).

Added tokens count as vocabulary, so their strings are never cut. A text without certain pairs
is one fragment. Work is row-local, without a shuffle; the table of encoded fragments that a worker
keeps is bounded and only saves time: once it is full, what wasn't asked for since the last time goes.

A short fragment of letters (with a space before them) or digits is one piece of the split pattern,
so its bytes are merged directly by rank, without the library's normalising and splitting. That is
sound if a token's id rises with its merge and every token encodes to itself, which is checked when a
vocabulary is loaded; otherwise, and for all other fragments, the library encodes.

Defined results: a null or empty text has no ids, and both digests are those of no bytes; repeated
rows are encoded each by itself; an empty table gives an empty result; other columns are ignored by
`digests` and kept by `encode` and `decode` (whose new column replaces one of the same name).
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from corpusq.llm.batches import pieces, text_bytes

KEEP_ENTRIES = 100_000
KEEP_BYTES = 64
#: Letters are ASCII or U+00C0 to U+017F without the signs among them.
ONE_PIECE = re.compile(rb" ?(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf]|[\xc4\xc5][\x80-\xbf])+| ?[0-9]+")
SEPARATOR = b"\xff"  # in no UTF-8 text
#: Last bytes of the white-space characters beyond ASCII.
WIDE_SPACE = [0x80, 0x81, 0x82, 0x83, 0x84, 0x85, 0x86, 0x87, 0x88, 0x89, 0x8A, 0x9F, 0xA0, 0xA8, 0xA9, 0xAF]


def byte_of() -> dict[str, int]:
    """The byte behind each character of a byte-level vocabulary: printable bytes stand for themselves, the rest follow from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Known(dict):
    """Ids of fragments, encoded when first asked for. Two generations of at most KEEP_ENTRIES: when the young one is full, it becomes the old one."""

    def __init__(self, encode) -> None:
        self.encode, self.old = encode, {}

    def __missing__(self, x: bytes) -> bytes:
        ids = self.old.get(x)
        if ids is None:
            ids = self.encode(x)
            if len(x) > KEEP_BYTES:
                return ids
        if len(self) >= KEEP_ENTRIES:
            self.old = dict(self)
            self.clear()
        self[x] = ids
        return ids


class Codec:
    """Encoder and decoder of one byte-level BPE file."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks are the parallel units
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        of = byte_of()
        tokens = {i: bytes(of[c] for c in t) for t, i in spec["model"]["vocab"].items()}
        tokens |= {t["id"]: t["content"].encode() for t in spec["added_tokens"]}
        self.bytes_of = [tokens.get(i, b"") for i in range(max(tokens) + 1)]
        self.cuts = self.certain(tokens.values())
        self.merge = self.by_rank(spec, of)
        self.known = Known(self.fragment)

    def by_rank(self, spec: dict, of: dict[str, int]):
        """A function from the bytes of one piece to its ids, or None if the vocabulary needs the library."""
        try:
            import tiktoken
        except ImportError:
            return None
        vocab, added = spec["model"]["vocab"], {t["content"] for t in spec["added_tokens"]}
        made = [vocab["".join(m if isinstance(m, list) else m.split(" "))] for m in spec["model"]["merges"]]
        ranks = {bytes(of[c] for c in t): i for t, i in vocab.items() if t not in added}
        whole = [t for t in ranks if ONE_PIECE.fullmatch(t)]
        rising = made == sorted(set(made)) and max((i for t, i in ranks.items() if len(t) == 1), default=0) < min(made, default=1)
        if not rising or [e.ids for e in self.tokenizer.encode_batch_fast([t.decode() for t in whole], add_special_tokens=False)] != [[ranks[t]] for t in whole]:
            return None
        return tiktoken.Encoding("ranks", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})._encode_single_piece

    @staticmethod
    def certain(tokens) -> np.ndarray:
        """A flag for each pair of bytes (256 * left + right) at which a text may be cut."""
        inside = np.zeros(65536, bool)
        for t in tokens:
            b = np.frombuffer(t, np.uint8).astype(np.int64)
            inside[b[:-1] * 256 + b[1:]] = True
        left, right = np.divmod(np.arange(65536), 256)
        blank = lambda b: (b == 0x20) | ((b >= 0x09) & (b <= 0x0D))
        maybe = blank(left) | ((left >= 0x1C) & (left <= 0x1F)) | np.isin(left, WIDE_SPACE)
        alnum = ((left | 0x20) >= 0x61) & ((left | 0x20) <= 0x7A) & (left < 0x80) | ((left >= 0x30) & (left <= 0x39))
        starts = (right < 0x80) | (right >= 0xC0)
        calm = blank(right) | ~maybe
        return ~inside & starts & calm & ((right != 0x27) | alnum)

    def fragments(self, text: bytes) -> list[bytes]:
        b = np.frombuffer(text, np.uint8)
        cut = self.cuts[(b[:-1].astype(np.uint16) << 8) | b[1:]]
        n = int(cut.sum())
        if not n:
            return [text]
        out = np.full(len(b) + n, 0xFF, np.uint8)
        at = np.arange(len(b))
        at[1:] += cut.cumsum()
        out[at] = b
        return out.tobytes().split(SEPARATOR)

    def fragment(self, x: bytes) -> bytes:
        """The ids of one fragment."""
        if self.merge is not None and len(x) <= KEEP_BYTES and ONE_PIECE.fullmatch(x):
            return np.array(self.merge(x), "<u4").tobytes()
        return np.array(self.tokenizer.encode(x.decode("utf-8", "replace"), add_special_tokens=False).ids, "<u4").tobytes()

    def encode(self, text: bytes) -> bytes:
        """The ids of a whole text, as little-endian unsigned 32-bit integers."""
        return b"".join(map(self.known.__getitem__, self.fragments(text))) if text else b""

    def decode(self, ids: bytes) -> bytes:
        """The text of ids as UTF-8; bytes that are no UTF-8 become U+FFFD."""
        out = b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))
        return out.decode("utf-8", "replace").encode()


@lru_cache(maxsize=4)
def codec(path: str) -> Codec:
    return Codec(path)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: every text encoded, and its ids decoded again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path or default_path())
        for b in pieces(batches, 1):
            n, ids_sha, text_sha = [], [], []
            for x in text_bytes(b.column(1)):
                ids = c.encode(x)
                n.append(len(ids) // 4)
                ids_sha.append(hashlib.sha256(ids).hexdigest())
                text_sha.append(hashlib.sha256(c.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encode(df: DataFrame, text: str = "text", ids: str = "ids", path: str | None = None) -> DataFrame:
    """df with the token ids of a text column as array<int>."""
    kept = [c for c in df.columns if c != ids]
    at = kept.index(text)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*kept).schema) + f", `{ids}` array<int>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path or default_path())
        for b in batches:
            found = [np.frombuffer(c.encode(x), "<i4") for x in text_bytes(b.column(at))]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(found, pa.list_(pa.int32()))], [*kept, ids])

    return df.select(*kept).mapInArrow(run, schema)


def decode(df: DataFrame, ids: str = "ids", text: str = "text", path: str | None = None) -> DataFrame:
    """df with the text of an array<int> column of token ids; null ids give an empty text."""
    kept = [c for c in df.columns if c != text]
    at = kept.index(ids)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*kept).schema) + f", `{text}` string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path or default_path())
        for b in batches:
            found = [c.decode(np.asarray(x or [], "<u4").tobytes()).decode() for x in b.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(found, pa.string())], [*kept, text])

    return df.select(*kept).mapInArrow(run, schema)
