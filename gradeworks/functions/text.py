"""Column functions over texts: tokens, n-grams, prompt parts, token limits."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from gradeworks.functions.batches import parts, ranges, token_texts

#: Tokens whose n-grams are made at a time; those of a longer text are made whole.
TOKENS = 1 << 15
#: Substrings of a text that are joined at a time.
WINDOWS = 1 << 16
LETTERS = "[^a-zа-яё0-9\\s]"


def parted(text: Column) -> Column:
    """The lower-cased text with a space for every other character than a-z, а-я, ё, digits and white space."""
    return F.regexp_replace(F.lower(text), LETTERS, " ")


def tokenize(text: Column) -> Column:
    """The tokens of ``parted`` text, between white space; null has none and stays null."""

    def run(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in columns:
            for lo, hi in parts((texts,)):
                part = texts.slice(lo, hi - lo)
                made, counts = token_texts(pc.fill_null(part, "").to_pylist())
                ends = pa.array(np.concatenate(([0], np.cumsum(counts))), pa.int32())
                yield pa.ListArray.from_arrays(ends, made, mask=part.is_null())

    return F.arrow_udf(run, "array<string>")(F.lower(text))


def _runs(values: pa.Array, sizes: np.ndarray, n: int, sep: str) -> pa.Array:
    """Lists of n consecutive ``values`` joined; ``sizes`` is how many values each list has."""
    most = max(len(values) - n + 1, 0)
    count = np.maximum(sizes - n + 1, 0)
    ends = np.concatenate(([0], np.cumsum(count)))
    at = np.arange(ends[-1]) + np.repeat(np.cumsum(sizes) - sizes - ends[:-1], count)
    joined = pc.binary_join_element_wise(*[values.slice(k, most) for k in range(n)], sep)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), joined.take(pa.array(at)))


def _windows(text: str, n: int, between: str) -> str:
    """All substrings of n characters joined, WINDOWS of them at a time."""
    codes, gap = (np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32) for t in (text, between))
    out = []
    for at in range(0, len(codes) - n + 1, WINDOWS):
        own = np.lib.stride_tricks.sliding_window_view(codes[at : at + WINDOWS + n - 1], n)
        rows = np.concatenate((own, np.broadcast_to(gap, (len(own), len(gap)))), 1)
        out.append(rows.ravel()[: rows.size - len(gap)].tobytes().decode("utf-32-le", "surrogatepass"))
    return between.join(out)


def _told(grams: pa.Array, between: str | None) -> pa.Array:
    """The lists as they are, or how many each holds and its items joined."""
    if between is None:
        return grams
    return pa.StructArray.from_arrays([grams.value_lengths().cast(pa.int64()), pc.binary_join(grams, between)], ["n", "joined"])


def _kind(between: str | None) -> str:
    return "array<string>" if between is None else "struct<n:long,joined:string>"


def word_ngrams(tokens: Column, n: int, between: str | None = None) -> Column:
    """n consecutive tokens joined by a space, with repeats; none if there are fewer than n.

    With ``between`` their number and all of them joined by it (n, joined), which Spark reads much faster than an array.
    """

    def run(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for lists in columns:
            sizes = pc.fill_null(lists.value_lengths(), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            total = np.cumsum(sizes)
            for lo, hi in ranges(total, TOKENS):
                yield _told(_runs(lists.slice(lo, hi - lo).flatten(), sizes[lo:hi], n, " "), between)

    return F.arrow_udf(run, _kind(between))(tokens)


def char_ngrams(text: Column, n: int, between: str | None = None) -> Column:
    """All substrings of n characters of the lower-cased text, white space included; ``between`` as in ``word_ngrams``."""

    def run(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in columns:
            for lo, hi in parts((texts,)):
                part = pc.fill_null(texts.slice(lo, hi - lo), "")
                if between is not None:
                    count = pc.max_element_wise(pc.subtract(pc.utf8_length(part), n - 1), 0).cast(pa.int64())
                    yield pa.StructArray.from_arrays([count, pa.array([_windows(t, n, between) for t in part.to_pylist()], pa.string())], ["n", "joined"])
                    continue
                data = np.frombuffer(b"".join(pc.cast(part, pa.binary()).to_pylist()), np.uint8)
                start = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data)).astype(np.int32)
                each = pa.StringArray.from_buffers(len(start) - 1, pa.py_buffer(start), pa.py_buffer(data))
                yield _runs(each, pc.utf8_length(part).to_numpy(zero_copy_only=False).astype(np.int64), n, "")

    return F.arrow_udf(run, _kind(between))(F.lower(text))


def estimate_tokens(text: Column, per_token: float = 3.0) -> Column:
    return F.ceil(F.coalesce(F.length(text), F.lit(0)) / F.lit(per_token)).cast("long")


def truncate_to_tokens(text: Column, most: int, per_token: float = 3.0) -> Column:
    """The text if it fits, else its first ceil(most * per_token) characters."""
    size = int(-(-most * per_token // 1))
    return F.when(estimate_tokens(text, per_token) <= most, text).otherwise(F.substring(text, 1, size))


def trimmed(text: Column) -> Column:
    """Without control characters and spaces at both ends."""
    return F.btrim(text, F.lit("".join(map(chr, range(33)))))


def blank(text: Column) -> Column:
    """Whether a text is null or holds nothing but white space; looks no further than its first other character."""
    return ~F.coalesce(text.rlike(r"(?U)\S"), F.lit(False))


def join_contexts(contexts: Column, sep: str) -> Column:
    return F.array_join(contexts, sep)


def normalized_entities(items: Column) -> Column:
    """Distinct trimmed lower-cased names without blanks."""
    return F.array_distinct(F.filter(F.transform(items, lambda x: F.lower(trimmed(x))), lambda x: x.isNotNull() & (x != "")))


def normalized_words(text: Column) -> Column:
    """The text between single spaces, each piece trimmed and lower-cased as ``normalized_entities`` does it, blank ones included.

    Pieces hold no space and case mapping sees none of another piece, so the whole text is lower-cased, and its control characters
    beside spaces go with the spaces.
    """
    control = "".join(map(chr, range(32)))
    return F.split(F.btrim(F.lower(text), F.lit(control)), r"[\x00-\x1f]* [\x00-\x1f]*")


def distinct_entities(words: Column) -> Column:
    """The distinct ones of normalized words that aren't blank."""
    return F.array_distinct(F.array_remove(words, ""))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors in double precision; 0 for a zero vector, null for unequal lengths."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(F.size(a) == F.size(b), F.when(norm == 0, F.lit(0.0)).otherwise(dot(a, b) / norm))


# Why a call failed, in the order in which the rules are tried, and the marks that each looks for.
REASONS = (
    ("empty response", ("empty", "Empty")),
    ("empty response", ("end-of-input", "No content to map")),
    ("markdown in response", ("code 96", "```")),
    ("text before JSON", ("Unrecognized token",)),
    ("truncated JSON", ("closing quote", "Unexpected end")),
    ("duplicate JSON key", ("No fallback setter/field", "duplicate")),
    ("parse error", ("parse", "Parse", "JSON")),
    ("timeout", ("timeout", "Timeout")),
    ("rate limited", ("rate limit", "429")),
    ("auth error", ("401", "Unauthorized")),
    ("server error", ("500", "Internal Server")),
)


def short_reason(error: Column) -> Column:
    """Why a call failed, in few words; the first rule that fits counts, case matters; else at most 50 characters of the message.

    Line feeds become spaces first. Null and blank messages are unknown errors.
    """
    clean = trimmed(F.replace(F.replace(error, F.lit("\n"), F.lit(" ")), F.lit("\r"), F.lit("")))
    out = F.when(error.isNull() | (clean == ""), F.lit("unknown error"))
    for name, marks in REASONS:
        hit = F.lit(False)
        for m in marks:
            hit = hit | clean.contains(m)
        out = out.when(hit, F.lit(name))
    return out.otherwise(F.when(F.length(clean) > 50, F.concat(F.substring(clean, 1, 47), F.lit("..."))).otherwise(clean))
