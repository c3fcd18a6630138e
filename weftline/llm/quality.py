"""Quality rules on repetition: characters inside duplicated n-grams and lines, by rolling hashes in numpy.

Words are runs of characters other than ASCII white space.  Every word has a 64-bit hash; a rolling polynomial over
the word hashes gives every window of n words one hash.  A word is covered for n when it lies in a window that has
occurred before in the text; the coverage is the covered words' characters over all word characters, so windows that
overlap count once.  Lines are measured by their word characters in the same way.

The base measures are exact: words and windows are numbered, not hashed.
Null and empty texts have no words and fail the base rules.  Texts are measured whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

from weftline.llm.tasks import chunks, ship, texts_of

SYMBOLS = b"#*$%&|<>"
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class Rules:
    """Shares above which a text is dropped.

    ``ngram_coverage`` gives, per length in words, the largest share of word characters inside windows seen before.
    The lengths are those published for a large web corpus (Rae et al., 2021).  The limits are looser than there, so
    that a short clean text may carry one line of boilerplate twice.
    """

    ngram_coverage: tuple[tuple[int, float], ...] = ((5, 0.25), (6, 0.24), (7, 0.23), (8, 0.22), (9, 0.21), (10, 0.20))
    line_coverage: float = 0.30
    symbol_share: float = 0.08  # symbols per word character


SCHEMA = (
    "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, "
    "dup_line_chars bigint, max_ngram_coverage double, base_failed boolean, kept boolean"
)


def covered(hashes: np.ndarray, n: int) -> np.ndarray:
    """Which of the words lie in a window of ``n`` hashes that has occurred before."""
    count = len(hashes)
    inside = np.zeros(count, bool)
    if count <= n:
        return inside
    rolled = rolling(hashes, n)
    order = np.argsort(rolled, kind="stable")
    equal = rolled[order][1:] == rolled[order][:-1]
    again = np.zeros(len(rolled), bool)
    again[order[1:]] = equal  # the sort is stable: the first of equal windows stands first
    return spread(again, n, count)


def rolling(hashes: np.ndarray, n: int) -> np.ndarray:
    """Polynomial hash of every window of ``n`` hashes, modulo 2^64."""
    windows = len(hashes) - n + 1
    out = np.zeros(windows, np.uint64)
    for i in range(n):
        out = out * MULTIPLIER + hashes[i : i + windows]
    return out ^ (out >> np.uint64(29))


def spread(starts: np.ndarray, n: int, count: int) -> np.ndarray:
    """Positions inside a window of ``n`` that begins at a marked start."""
    steps = np.zeros(count + 1, np.int64)
    at = np.flatnonzero(starts)
    np.add.at(steps, at, 1)
    np.add.at(steps, at + n, -1)
    return np.cumsum(steps[:-1]) > 0


def repeat_words(numbers: np.ndarray) -> int:
    """Words in 3-word windows found twice or more, exactly: windows are numbered pair by pair."""
    count = len(numbers)
    if count < 4:
        return 0
    top = int(numbers.max()) + 1
    if top < 2_000_000:  # three numbers fit one long
        window = (numbers[:-2] * top + numbers[1:-1]) * top + numbers[2:]
    else:
        pairs = np.unique(numbers[:-1] * top + numbers[1:], return_inverse=True)[1].astype(np.int64)
        window = pairs[:-1] * top + numbers[2:]
    _, inverse, found = np.unique(window, return_inverse=True, return_counts=True)
    return int(spread(found[inverse] > 1, 3, count).sum())


class _Words(dict):
    """64-bit hashes of words, computed once per chunk."""

    def __missing__(self, word: bytes) -> int:
        self[word] = value = xxhash.xxh3_64_intdigest(word)
        return value


def measures(text: str, memo: dict, rules: Rules) -> tuple:
    """The columns of SCHEMA after the id, for one text."""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()  # bytes split at \x20 and \x09-\x0D only
    n_words = len(words)
    if not n_words:
        return 0, 0, _symbols(raw), 0, 0, 0, 0.0, True, False
    values = np.fromiter(map(memo.__getitem__, words), np.uint64, n_words)
    sizes = np.fromiter(map(len, words), np.int64, n_words)
    if not raw.isascii():
        sizes = _code_points(words, sizes)
    word_chars = int(sizes.sum())
    n_dup, dup_chars = _lines(raw)
    number: dict = {}
    numbers = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, n_words)
    repeated = repeat_words(numbers)
    base_failed = n_words < 50 or 100 * repeated > 50 * n_words
    n_symbols = _symbols(raw)
    most, failed = 0.0, False
    if repeated:  # a longer window can only repeat where a 3-word window does
        for n, limit in rules.ngram_coverage:
            share = float(sizes[covered(values, n)].sum()) / word_chars
            most, failed = max(most, share), failed or share > limit
            if not share:
                break  # no repeated window of n words, so none of more
    failed = failed or dup_chars > rules.line_coverage * word_chars or n_symbols > rules.symbol_share * word_chars
    return n_words, word_chars, n_symbols, n_dup, repeated, dup_chars, most, base_failed, not (base_failed or failed)


def _symbols(raw: bytes) -> int:
    return len(raw) - len(raw.translate(None, SYMBOLS))


def _code_points(words: list[bytes], sizes: np.ndarray) -> np.ndarray:
    flat = np.frombuffer(b"".join(words), np.uint8)
    leads = np.zeros(len(flat) + 1, np.int64)
    np.cumsum((flat & 0xC0) != 0x80, out=leads[1:])
    ends = np.cumsum(sizes)
    return leads[ends] - leads[ends - sizes]


def _lines(raw: bytes) -> tuple[int, int]:
    """Lines with a word that equal an earlier line, and the characters of their words."""
    if b"\n" not in raw:
        return 0, 0
    seen: set = set()
    count = chars = 0
    for line in raw.split(b"\n"):
        if line in seen:
            count += 1
            chars += len(b"".join(line.split()).decode("utf-8", "surrogatepass"))
        elif line and not line.isspace():
            seen.add(line)
    return count, chars


def _measured(rules: Rules):
    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        kinds = [pa.int64()] * 7 + [pa.float64(), pa.bool_(), pa.bool_()]
        for chunk in chunks(batches):
            memo = _Words()
            rows = [measures(t, memo, rules) for t in texts_of(chunk)]
            columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([chunk.column("doc_id").cast(pa.int64()), *columns], names=names)

    return measure


def repetition_measures(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """SCHEMA for every row of ``docs``; one narrow pass, nothing is shuffled."""
    ship(docs.sparkSession)
    return docs.selectExpr("cast(doc_id as bigint) doc_id", "cast(text as string) text").mapInArrow(_measured(rules), SCHEMA)


def _passing(rules: Rules):
    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks(batches):
            memo = _Words()
            yield chunk.filter(pa.array([measures(t, memo, rules)[-1] for t in texts_of(chunk)], pa.bool_()))

    return keep


def keep_clean(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """The rows of ``docs`` that pass the base rules and the repetition rules, all columns unchanged."""
    ship(docs.sparkSession)
    return docs.mapInArrow(_passing(rules), docs.schema)
