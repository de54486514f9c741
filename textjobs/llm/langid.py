"""Language identification by error-correcting output codes.

Every language has a codeword of bits.  For every bit a binary classifier over
byte trigrams (log-odds of the languages whose bit is 1 against the others)
predicts the bit of a text; decoding takes the codeword with the least
weighted loss, a classifier weighing more the fewer errors it made.
"""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from textjobs.llm.columns import held, slices, small_batches
from textjobs.sources.files import save_and_reread

FEATURE_BITS, MOST_BITS, UNDETERMINED = 15, 15, "und"
#: Rows of a language that the fit reads (about; whole texts), tasks that count them.
FIT_ROWS, FIT_TASKS = 5_000, 8
#: Below this score a text is flagged as ambiguous.
AMBIGUOUS = 0.6

_FOLD = np.full(256, 32, np.uint8)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)
_ASCII_LETTER = np.zeros(256, bool)
_ASCII_LETTER[65:91] = _ASCII_LETTER[97:123] = True


def codewords(n: int, most: int = MOST_BITS) -> np.ndarray:
    """``n`` words of +1/-1 bits.  Up to five languages: every way to part them
    once; more: the seeded random code, of several, with the largest least distance."""
    if n <= 2:
        return np.array([[1], [-1]][:max(n, 0)], np.float64).reshape(n, -1)
    if n <= 5:
        columns = np.arange(1, 1 << (n - 1))
        rows = np.arange(n - 1, -1, -1)[:, None]
        return np.where((columns[None, :] >> rows) & 1, 1.0, -1.0)
    width = max(most, int(4 * np.ceil(np.log2(n))))
    rng, best, far = np.random.default_rng(7), None, -1
    for _ in range(200):
        code = rng.choice([-1.0, 1.0], size=(n, width))
        least = int(((width - code @ code.T) / 2 + width * np.eye(n)).min())
        if least > far and (np.abs(code.sum(axis=0)) < n).all():
            best, far = code, least
    return best


def trigrams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(feature of every letter with its neighbours, features before each row)."""
    cur = _FOLD[data]
    prev, after = np.empty_like(cur), np.empty_like(cur)
    prev[1:], after[:-1] = cur[:-1], cur[1:]
    prev[offsets[offsets < len(data)]] = 32
    after[offsets[offsets > 0] - 1] = 32
    at = np.flatnonzero(cur != 32)
    gram = prev[at].astype(np.uint32) << np.uint32(16) | cur[at].astype(np.uint32) << np.uint32(8) | after[at]
    return (gram * np.uint32(0x9E3779B1)) >> np.uint32(32 - FEATURE_BITS), np.searchsorted(at, offsets)


def row_sums(values: np.ndarray, before: np.ndarray) -> np.ndarray:
    """Sums of the rows [before[r], before[r + 1]); rows without a value are 0."""
    out = np.zeros((len(before) - 1, values.shape[1]))
    full = np.flatnonzero(np.diff(before))
    if len(full):
        out[full] = np.add.reduceat(values, before[:-1][full], axis=0, dtype=np.float64)
    return out


def has_letter(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    plain = np.concatenate(([0], np.cumsum(_ASCII_LETTER[data])))[offsets]
    out = np.diff(plain) > 0
    for r in np.flatnonzero(~out).tolist():
        out[r] = any(map(str.isalpha, data[offsets[r]:offsets[r + 1]].tobytes().decode()))
    return out


@dataclass
class LanguageModel:
    """languages: their names; code: languages x bits; odds: features x bits;
    scale, weight: of every bit."""
    languages: list[str]
    code: np.ndarray
    odds: np.ndarray
    scale: np.ndarray
    weight: np.ndarray

    def margins(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Mean log-odds of every bit in every row."""
        grams, before = trigrams(data, offsets)
        return row_sums(self.odds.take(grams, axis=0), before) / np.maximum(np.diff(before), 1)[:, None]

    def decode(self, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index of the nearest codeword, its share of the likelihood)."""
        z = (margins * self.scale)[:, None, :] * self.code[None, :, :]
        loss = (np.logaddexp(0, -z) * self.weight).sum(axis=2)
        share = np.exp(-(loss - loss.min(axis=1, keepdims=True)))
        return loss.argmin(axis=1), 1 / share.sum(axis=1)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[str, np.ndarray] = {}
    for batch in batches:
        for low, high, data, offsets in slices(batch.column("text")):
            grams, before = trigrams(data, offsets)
            langs = np.array(batch.column("lang").slice(low, high - low).to_pylist(), object)
            of = np.repeat(np.arange(high - low), np.diff(before))
            for lang in set(langs):
                own = np.bincount(grams[(langs == lang)[of]], minlength=1 << FEATURE_BITS)
                counts[lang] = counts.get(lang, 0) + own
    for lang, own in counts.items():
        yield pa.RecordBatch.from_pydict({"lang": [lang], "counts": [own.astype("<i8").tobytes()]})


def _tested(model: LanguageModel):
    index = {x: i for i, x in enumerate(model.languages)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((3, model.code.shape[1]))  # rows, errors, absolute margins
        for batch in batches:
            for low, high, data, offsets in slices(batch.column("text")):
                m = model.margins(data, offsets)
                code = model.code[[index[x] for x in batch.column("lang").slice(low, high - low).to_pylist()]]
                sums += np.stack([np.ones_like(m), m * code <= 0, np.abs(m)]).sum(axis=1)
        yield pa.RecordBatch.from_pydict({"sums": [sums.ravel().tolist()]})

    return run


def highest_hash(n: int, wanted: int) -> int:
    """The 64-bit hash up to which about ``wanted`` of ``n`` rows lie."""
    return (1 << 63) - 1 if wanted >= n else (wanted << 64) // n - (1 << 63)


def fit(docs: DataFrame, learn: Column, fit_rows: int = FIT_ROWS) -> LanguageModel | None:
    """Fits on rows with ``learn`` and a text and a lang: of every language
    all rows, or about ``fit_rows`` of those with the least hash of doc_id and
    text, and always one.  Equal rows are chosen together.  What reaches the
    driver is a vector of counts per language and task (``FIT_TASKS``),
    whatever the size of the table.  None when there is no such row."""
    usable = small_batches(docs).filter(learn & F.col("lang").isNotNull() & F.col("text").isNotNull())
    usable = usable.select("text", "lang", F.xxhash64("doc_id", "text").alias("h"))
    sizes = usable.groupBy("lang").agg(F.count("*").alias("n"), F.min("h").alias("least")).collect()  # one row a language
    if not sizes:
        return None
    most = [F.lit(x) for r in sizes for x in (r["lang"], max(r["least"], highest_hash(r["n"], fit_rows)))]
    part = F.col("h") <= F.try_element_at(F.create_map(*most), F.col("lang"))
    sample = save_and_reread(usable.filter(part).select("text", "lang").repartition(FIT_TASKS), "langid-sample")
    counts: dict[str, np.ndarray] = {}
    for row in sample.mapInArrow(_counted, "lang string, counts binary").toLocalIterator():
        counts[row["lang"]] = counts.get(row["lang"], 0) + np.frombuffer(row["counts"], "<i8")
    languages = sorted(counts)
    if not languages:
        return None
    code = codewords(len(languages))
    shares = np.stack([(c + 0.5) / (c.sum() + 0.5 * len(c)) for c in (counts[x] for x in languages)])
    sides = [np.stack([shares[code[:, b] == side].mean(axis=0) if (code[:, b] == side).any() else np.full(
        shares.shape[1], 1 / shares.shape[1]) for b in range(code.shape[1])], axis=1) for side in (1, -1)]
    bits = code.shape[1]
    model = LanguageModel(languages, code, np.log(sides[0] / sides[1]).astype(np.float32), np.ones(bits), np.ones(bits))
    rows = sample.mapInArrow(_tested(model), "sums array<double>").toLocalIterator()
    total = np.sum([r["sums"] for r in rows], axis=0).reshape(3, bits)
    error = (total[1] + 1) / (total[0] + 2)
    model.scale = 3 * total[0] / np.maximum(total[2], 1e-9)
    model.weight = np.maximum(np.log((1 - error) / error), 0.05)
    model.weight /= model.weight.mean()
    return model


def predict(docs: DataFrame, model: LanguageModel | None) -> DataFrame:
    """``docs`` with lang_pred, score (0 to 1) and ambiguous.

    A null text or one without a letter is ``und`` with score 0, and so is
    every text without a model.  Only the text is used.  Columns of these names
    are replaced; an empty table gives an empty one.
    """
    docs = small_batches(docs.drop("lang_pred", "score", "ambiguous"))
    schema = T.StructType([
        *docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()),
        T.StructField("ambiguous", T.BooleanType()),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held("langid")
        for batch in batches:
            found, scores = [], []
            for _, _, data, offsets in slices(batch.column(batch.schema.get_field_index("text")), 1 << 20):
                known = has_letter(data, offsets) if model else np.zeros(len(offsets) - 1, bool)
                if model:
                    best, share = model.decode(model.margins(data, offsets))
                    names = np.array(model.languages, object)[best]
                else:
                    names, share = np.full(len(known), UNDETERMINED, object), np.zeros(len(known))
                found += np.where(known, names, UNDETERMINED).tolist()
                scores += np.where(known, share, 0.0).tolist()
            yield pa.RecordBatch.from_arrays([
                *batch.columns, pa.array(found, pa.string()), pa.array(scores, pa.float64()),
                pa.array(np.array(scores) < AMBIGUOUS),
            ], names=[*batch.schema.names, "lang_pred", "score", "ambiguous"])

    return docs.mapInArrow(run, schema)


def held_out() -> Column:
    """Whether crc32 of doc_id as text leaves 2 when divided by 4; false for null."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
