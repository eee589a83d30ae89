"""Token counts of fields by offset-mapped attribution.

A record (all fields, joined by a separator) is encoded once. The tokens of a byte-level vocabulary are byte strings whose
concatenation is the record, so their lengths give each token's span; spans are mapped to characters and joined to the
spans of the fields. A token that crosses a boundary goes by an explicit rule.
"""

from __future__ import annotations

import base64
import re
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Where the vocabulary lies by default; a parameter of every function.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the pattern that goes with the vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
SEPARATOR = "\n"
#: Blanks in a row from which they are encoded without the pattern, whose look-ahead fails on a million; fixed value: the
#: characters that it takes for blanks.
MANY_BLANKS = 100_000
BLANK = r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
#: first: to the field of the token's first character. majority: to the field with most of its characters, of equals
#: the first.
RULES = ("first", "majority")


@lru_cache(2)
def vocabulary(path: str) -> dict[bytes, int]:
    with open(path) as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


@lru_cache(2)
def encoding(path: str):
    """The encoder, and the number of bytes of each token."""
    import tiktoken

    ranks = vocabulary(path)
    size = np.zeros(max(ranks.values()) + 1, np.int64)
    for token, rank in ranks.items():
        size[rank] = len(token)
    return tiktoken.Encoding("fields", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}), size


@lru_cache(2)
def piece_encoding(path: str):
    """An encoder that takes any text as one piece of the pattern."""
    import tiktoken

    return tiktoken.Encoding("piece", pat_str=r"(?s:.+)", mergeable_ranks=vocabulary(path), special_tokens={})


def encoded(text: str | None, path: str) -> np.ndarray:
    """Ids of the tokens of a text.

    In a row of blanks the pattern takes all but the last for one piece, or all of them at the end of the text. Where there
    are very many, that piece is found here and merged as it is, so that the ids are those of the text encoded whole."""
    encoder, _ = encoding(path)
    if not text:
        return np.zeros(0, np.uint32)
    if len(text) < MANY_BLANKS:
        return encoder.encode_to_numpy(text, disallowed_special=())
    out, at = [], 0
    for run in re.finditer(f"{BLANK}{{{MANY_BLANKS},}}", text):
        end = run.end() - (run.end() < len(text))
        out += [encoder.encode_to_numpy(text[at : run.start()], disallowed_special=()), piece_encoding(path).encode_to_numpy(text[run.start() : end], disallowed_special=())]
        at = end
    return np.concatenate([*out, encoder.encode_to_numpy(text[at:], disallowed_special=())])


def spans_of(fields: list[str | None], separator: str = SEPARATOR) -> tuple[str, np.ndarray, np.ndarray]:
    """The record, and where each field begins and ends in it, in characters."""
    texts = [f or "" for f in fields]
    length = np.array([len(t) for t in texts], np.int64)
    start = np.cumsum(length + len(separator)) - length - len(separator)
    return separator.join(texts), start, start + length


def attribute(fields: list[str | None], path: str = VOCABULARY, rule: str = "majority") -> tuple[np.ndarray, np.ndarray, np.ndarray, int, int]:
    """Start, end and tokens of each field, tokens of the separators, and tokens that cross a boundary."""
    record, start, end = spans_of(fields)
    data = record.encode("utf-8", "replace")
    _, size = encoding(path)
    ids = encoded(data.decode("utf-8"), path)
    after = np.cumsum(size[ids])
    # characters before each byte offset: a character belongs to the token with its first byte
    lead = np.concatenate(([0], np.cumsum((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)))
    first, last = lead[np.concatenate(([0], after[:-1]))], lead[after]
    inside = first == last  # the token has only later bytes of a character, and lies where that character is
    first = np.where(inside, np.maximum(first - 1, 0), first)
    last = np.where(inside, first + 1, last)
    # segments: field 0, separator, field 1, separator, ...; empty ones hold no character
    bounds = np.stack([start, end], 1).ravel()[1:]
    at = np.searchsorted(bounds, first, "right")
    till = np.searchsorted(bounds, last - 1, "right")
    crosses = at != till
    owner = at
    if rule == "majority" and crosses.any():
        owner = at.copy()
        for i in np.flatnonzero(crosses):
            edges = np.clip(np.concatenate(([first[i]], bounds[at[i] : till[i]], [last[i]])), first[i], last[i])
            owner[i] = at[i] + int(np.argmax(np.diff(edges)))
    counts = np.bincount(owner, minlength=2 * len(fields))
    return start, end, counts[0 : 2 * len(fields) : 2], int(counts[1::2].sum()), int(crosses.sum())


def token_counts(docs: DataFrame, fields: dict[str, Column], path: str = VOCABULARY, rule: str = "majority") -> DataFrame:
    """doc_id, field, start_char, end_char, tokens, record_tokens, separator_tokens, crossing: one row for each row of docs
    and field, in the order of the record.

    tokens of the fields and separator_tokens add up to record_tokens, the length of the record encoded whole. Null and
    empty fields have empty spans and 0 tokens. Repeated rows are counted each. An empty table gives an empty result.
    Very long texts are encoded whole."""
    if rule not in RULES:
        raise ValueError(f"rule is one of {', '.join(RULES)}")
    names = list(fields)

    def run(batches):
        for pdf in batches:
            out = []
            for doc_id, *texts in pdf.itertuples(index=False, name=None):
                start, end, tokens, between, crossing = attribute(texts, path, rule)
                total = int(tokens.sum()) + between
                out += [(doc_id, k, s, e, t, total, between, crossing) for k, s, e, t in zip(names, start.tolist(), end.tolist(), tokens.tolist())]
            yield pd.DataFrame(out, columns=["doc_id", "field", "start_char", "end_char", "tokens", "record_tokens", "separator_tokens", "crossing"])

    # the id passes outside of Python, where a null among ids would turn them all into floating point
    texts = [c.cast("string").alias(f"f{i}") for i, c in enumerate(fields.values())]
    rows = docs.select(F.to_json(F.struct("doc_id")).alias("doc_id"), *texts)
    out = rows.mapInPandas(run, "doc_id string, field string, start_char long, end_char long, tokens long, record_tokens long, separator_tokens long, crossing long")
    return out.withColumn("doc_id", F.from_json("doc_id", docs.select("doc_id").schema)["doc_id"])


def document_fields() -> dict[str, Column]:
    """Fields of a document: source, language, first line and the lines after it."""
    cut = F.instr("text", "\n")
    title = F.when(cut > 0, F.substring("text", F.lit(1), cut - 1)).otherwise(F.col("text"))
    body = F.when(cut > 0, F.substring("text", cut + 1, F.length("text")))
    return {"source": F.col("source"), "lang": F.col("lang"), "title": title, "body": body}
