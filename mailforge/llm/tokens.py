"""Problem 8: token ids of a whole corpus by a public byte-level BPE.

Texts are encoded batch by batch next to the scan, without a shuffle. A run of letters, digits, signs or white space that the
pre-tokeniser cannot split is encoded by tree concatenation once it is long: halves are encoded on their own (in parallel
threads, the encoder frees the interpreter lock), then a window around each join is encoded again and grows until its first and
last tokens agree with both sides. As a byte-pair encoding is the only sequence whose neighbouring tokens all encode to
themselves, agreement at both ends makes the joined sequence the exact encoding.

Defined results: null and empty texts give an empty list; white space is text; special-token strings are ordinary text; an empty
table gives no rows; repeated doc_ids are encoded again each time.
"""

from __future__ import annotations

import base64
from concurrent.futures import ThreadPoolExecutor
from functools import cache

import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame

from mailforge.session import spread

#: Where the public vocabularies lie; a parameter of every operator.
TOKENIZERS = "/opt/tokenizers"
#: Fixed value: the pre-tokenisation pattern of the byte-level vocabularies.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Code points from which an unsplit run is encoded by halves.
LONG_RUN = 4096
LEAF = 1024
_pre = regex.compile(PATTERN)


@cache
def encoding(name: str, folder: str = TOKENIZERS) -> tiktoken.Encoding:
    with open(f"{folder}/{name}.tiktoken", "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding(name, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


@cache
def token_lengths(name: str, folder: str = TOKENIZERS):
    """Bytes of each token id."""
    import numpy as np

    e = encoding(name, folder)
    out = np.zeros(e.max_token_value + 1, np.int32)
    for token, rank in e._mergeable_ranks.items():
        out[rank] = len(token)
    return out


def join_exactly(left: list[int], right: list[int], single, decode) -> list[int]:
    """The encoding of two neighbouring stretches of one run from their own encodings."""
    k = 4
    while True:
        a, b = left[-k:], right[:k]
        middle = single(decode(a + b))
        open_left, open_right = len(a) == len(left), len(b) == len(right)
        if (open_left or middle[0] == a[0]) and (open_right or middle[-1] == b[-1]) and (len(middle) > 1 or (open_left and open_right)):
            return left[: len(left) - len(a)] + middle + right[len(b) :]
        k *= 2


def encode_run(run: bytes, single, decode, pool: ThreadPoolExecutor | None = None) -> list[int]:
    if len(run) <= LEAF:
        return single(run)
    leaves = [run[i : i + LEAF] for i in range(0, len(run), LEAF)]
    parts = list(pool.map(single, leaves)) if pool else [single(x) for x in leaves]
    while len(parts) > 1:
        parts = [join_exactly(*parts[i : i + 2], single, decode) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
    return parts[0]


_long_run = regex.compile(r"[^\s]{%d,}|\s{%d,}" % (LONG_RUN, LONG_RUN))


def encode(text: str | None, enc: tiktoken.Encoding, pool: ThreadPoolExecutor | None = None) -> list[int]:
    if not text:
        return []
    if len(text) < LONG_RUN or not _long_run.search(text):
        return enc.encode_ordinary(text)
    out: list[int] = []
    core = enc._core_bpe
    short, spaces = 0, []  # where the part not yet encoded begins; the white-space pre-tokens at its end
    for m in _pre.finditer(text):
        if m.end() - m.start() >= LONG_RUN:
            # At the end of a slice white space would be one pre-token, so what stands before the run is encoded singly.
            solid = spaces[0].start() if spaces else m.start()
            out += enc.encode_ordinary(text[short:solid]) if solid > short else []
            for x in spaces:
                out += core.encode_single_piece(x.group().encode("utf-8"))
            out += encode_run(m.group().encode("utf-8", "replace"), core.encode_single_piece, lambda t: b"".join(core.decode_single_token_bytes(x) for x in t), pool)
            short, spaces = m.end(), []
        elif m.group().isspace():
            spaces.append(m)
        else:
            spaces.clear()
    return out + enc.encode_ordinary(text[short:])


def token_ids(documents: DataFrame, name: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """(doc_id, ids) of each row."""

    def run(batches):
        enc = encoding(name, folder)
        with ThreadPoolExecutor(2) as pool:
            for b in batches:
                texts = b.column("text").to_pylist()
                ids = [encode(t, enc, pool) for t in texts]
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return spread(documents.select("doc_id", "text")).mapInArrow(run, "doc_id long, ids array<int>")


def token_counts(documents: DataFrame, name: str, folder: str = TOKENIZERS) -> DataFrame:
    """(doc_id, n_tokens) of each row."""

    def run(batches):
        enc = encoding(name, folder)
        for b in batches:
            n = [len(encode(t, enc)) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int32())], ["doc_id", "n_tokens"])

    return spread(documents.select("doc_id", "text")).mapInArrow(run, "doc_id long, n_tokens int")
