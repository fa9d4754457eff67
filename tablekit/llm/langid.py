"""Language ID (operator 10) by string kernels.

The kernel of two texts is the number of character n-grams (n = 1 to ``MAX_N``, lower case,
letters, everything else one blank) that both contain, divided by the root of the product of
their own numbers: a blended spectrum of presences. Kernel ridge regression, one language
against the rest, is fitted in the Nyström space of landmark texts: with K the landmarks'
kernel matrix and C that of the sample with the landmarks, features are C K^(-1/2). All of
it is linear in the presences, so the landmarks, the root and the weights fold into one
matrix of n-grams by languages, and texts are scored in batches as presence matrix times
that matrix. N-grams that no landmark has are not part of the feature space.

``fit`` learns on a bounded sample, at most ``per_lang`` labelled texts of at most
``max_chars`` characters for each language, chosen by hash; ``predict`` reads every whole
text, long ones in segments.

The values of all languages for a text sum to 2 - K for K languages, so the winner's score
cannot tell that a text is in none of them. Two other figures can. One is the share of known
n-grams: of the longest n-grams with a letter in the middle, those that the landmarks have
and that hold no letter that no landmark has; tokens with digits (keys, addresses) aside.
The other is the margin, the winner's value over the second one's. ``fit`` learns again
without each language in turn and takes as least share and least margin what 99 % of that
language's texts stay below; the least share allows at least three times the unknown n-grams
that 99 % of the learned texts stay within. A text is in none of the languages when it is
below both, the share by more than two standard errors (few or repeated words say little),
or when it is below half of the least share.

Defined cases: a null text and one without a letter are ``und`` with score 0; a table
without labelled texts gives a model that calls everything ``und``; ties go to the first
language in alphabetical order; repeated rows are predicted alike; columns pass through
(those of the result's names are replaced); empty tables give empty tables.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_N = 3
ROWS_AT_ONCE = 128
SEGMENT = 1 << 20
TABLE_CODES = 1 << 24
LETTER = re.compile(r"[^\W\d_]")
DIGIT_TOKEN = re.compile(r"[^\s\d]*+\d\S*")
UNKNOWN = "und"
#: Fewer texts than these say nothing about unlearned languages; no text is rejected then.
LEAST_TEXTS = 20
#: Languages left out in turn.
LEFT_OUT = 16


@dataclass
class Model:
    """letters: code point of each symbol from 1 on (0 is the blank); known: sorted codes of
    the landmarks' n-grams, whose columns count from 1; weights: n-grams by languages;
    least_share, least_margin: what most texts of unlearned languages stay below."""

    langs: list[str]
    letters: object
    known: object
    weights: object
    bias: object = 0.0
    least_share: float = 0.0
    least_margin: float = math.inf

    def in_none(self, text: str, margin: float, table) -> bool:
        share, least = known_share(text, self, table), self.least_share
        if share >= least or share < least / 2:
            return share < least
        distinct = len(set(zip(*[text[i : SEGMENT + i].lower() for i in range(MAX_N)])))
        error = math.sqrt(least * (1 - least) * MAX_N / max(distinct, 1))  # a letter is in MAX_N of them
        return share + 2 * error < least and margin < self.least_margin

    def columns(self, codes):
        """Column of each n-gram, 0 if unknown; small alphabets get a table of all codes."""
        import numpy as np

        total = sum((len(self.letters) + 1) ** n for n in range(1, MAX_N + 1))
        if total <= TABLE_CODES:
            if not hasattr(self, "_table"):
                self._table = np.zeros(total, np.int32)
                self._table[self.known] = np.arange(1, len(self.known) + 1)
            return self._table[codes]
        at = np.minimum(np.searchsorted(self.known, codes), len(self.known) - 1)
        return np.where(self.known[at] == codes, at + 1, 0)

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "_table"}

    def table(self):
        """Symbol of every code point up to the largest letter; one more for all beyond."""
        import numpy as np

        out = np.zeros((int(self.letters.max()) if len(self.letters) else 0) + 2, np.int64)
        out[self.letters] = np.arange(1, len(self.letters) + 1)
        return out


def _symbols(text: str, table):
    import numpy as np

    points = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "replace"), np.uint32)
    return table[np.minimum(points, len(table) - 1)]


def _codes(symbols, size: int):
    """Codes of all n-grams: symbols as digits, and a place of its own for each n."""
    code, base = symbols, 0
    for n in range(1, MAX_N + 1):
        yield base + code
        base += size**n
        if n < MAX_N:
            code = code[:-1] * size + symbols[n:]


def presence(texts, model: Model, table):
    """Matrix of texts by known n-grams, 1 where the text has it."""
    import numpy as np

    size = len(model.letters) + 1
    out = np.zeros((len(texts), len(model.weights)), np.float32)
    for row, text in zip(out, texts):
        for at in range(0, max(len(text), 1), SEGMENT):
            part = text[at : at + SEGMENT + MAX_N - 1]  # segments overlap by an n-gram
            for codes in _codes(_symbols(part, table), size):
                row[model.columns(codes)] = 1
    out[:, 0] = 0
    return out


@lru_cache(1)
def _alphabetic():
    """Whether each code point is a letter."""
    import numpy as np

    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def _windows(text: str, model: Model, table):
    """Columns of the longest n-grams with a letter in the middle; 0 if unknown."""
    import numpy as np

    points = np.frombuffer(f" {DIGIT_TOKEN.sub(' ', text.lower())} ".encode("utf-32-le", "replace"), np.uint32)
    symbols, letter = table[np.minimum(points, len(table) - 1)], _alphabetic()[points]
    *_, codes = _codes(symbols, len(model.letters) + 1)
    foreign = letter & (symbols == 0)
    n = len(codes)
    known = ~np.logical_or.reduce([foreign[i : i + n] for i in range(MAX_N)])
    return np.where(known, model.columns(codes), 0)[letter[MAX_N // 2 :][:n]]


def known_share(text: str, model: Model, table) -> float:
    """Share of known n-grams, 0 without a letter."""
    known = total = 0
    for at in range(0, len(text), SEGMENT):
        columns = _windows(text[at : at + SEGMENT + MAX_N - 1], model, table)
        known, total = known + int((columns > 0).sum()), total + len(columns)
    return known / total if total else 0.0


def _solve(gram, cross, truth, n_langs: int, ridge: float):
    """Ridge regression in the landmarks' space: weights by landmark and language, biases.
    gram: kernel of the landmarks, cross: of the texts with them."""
    import numpy as np

    values, vectors = np.linalg.eigh(gram)
    good = values > 1e-8 * values.max()
    root = vectors[:, good] / np.sqrt(values[good])  # K^(-1/2) up to a rotation
    features = cross @ root
    target = np.where(truth[:, None] == np.arange(n_langs), 1.0, -1.0)
    ones = np.concatenate([features, np.ones((len(features), 1))], axis=1)
    weight = np.ones(len(truth)) / np.bincount(truth, minlength=n_langs)[truth]  # languages count alike
    left = (ones * weight[:, None]).T @ ones + ridge * np.diag([1.0] * features.shape[1] + [0.0])
    solved = np.linalg.solve(left + 1e-12 * np.eye(len(left)), (ones * weight[:, None]).T @ target)
    return root @ solved[:-1], solved[-1]


def _limits(texts, truth, marks, mark_truth, holders, gram, cross, apart, model: Model, ridge: float):
    """Least share and margin. holders: landmarks by n-gram and language; apart: what the
    kernels of a text grow by when the n-grams of its own language only are unknown."""
    import numpy as np

    n_langs, table, marked = len(model.langs), model.table(), set(marks)
    if len(set(texts)) < LEAST_TEXTS:
        return 0.0, math.inf
    every = holders.sum(axis=1)
    own, without = [], []
    for t, lang in {t: lang for t, lang in zip(texts, truth)}.items():
        at = _windows(t, model, table)
        if len(at):
            own.append((every[at] > (t in marked)).mean())
            without.append((every[at] > holders[at, lang]).mean())
    low = float(np.quantile(own, 0.01))
    if n_langs == 1:
        return low / 2, math.inf
    share, margins = min(1 - 3 * (1 - low), float(np.quantile(without, 0.99))), []
    for lang in range(n_langs if n_langs > 2 else 0)[:LEFT_OUT]:
        rest, seen = mark_truth != lang, truth != lang
        others = truth[seen] - (truth[seen] > lang)
        weights, bias = _solve(gram[np.ix_(rest, rest)], cross[np.ix_(seen, rest)], others, n_langs - 1, ridge)
        value = np.sort((cross[np.ix_(~seen, rest)] * apart[~seen, None]) @ weights + bias, axis=1)
        margins.extend(value[:, -1] - value[:, -2])
    return share, float(np.quantile(margins, 0.99)) if margins else math.inf


def scores(texts, model: Model, table):
    import numpy as np

    p = presence(texts, model, table)
    own = np.sqrt(np.maximum(p.sum(axis=1), 1.0))
    return (p @ model.weights) / own[:, None]


def fit(df: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", per_lang: int = 400, landmarks_per_lang: int = 40, max_chars: int = 20_000, ridge: float = 1e-2) -> Model:
    """Learn from the labelled rows of ``df``. Rows are chosen by a hash of id and text: per
    language a share that gives about twice ``per_lang``, of which the lowest hashes stay."""
    import numpy as np

    rows = df.select(F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"), F.xxhash64(F.col(id_col), F.col(text_col)).alias("h"))
    rows = rows.where(F.col("lang").isNotNull() & (F.length("text") <= max_chars) & F.col("text").rlike(r"\p{L}"))
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    langs = sorted(counts)
    if not langs:
        return Model([], np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((1, 0)))
    million = 1_000_000
    share = F.create_map(*[F.lit(x) for lang in langs for x in (lang, min(million, -(-2 * million * per_lang // counts[lang])))])
    picked = rows.where(F.pmod("h", F.lit(million)) < share[F.col("lang")]).collect()
    by_lang = {lang: sorted((r["h"], r["text"]) for r in picked if r["lang"] == lang)[:per_lang] for lang in langs}
    texts = [t for lang in langs for _, t in by_lang[lang]]
    truth = np.array([i for i, lang in enumerate(langs) for _ in by_lang[lang]])
    marks = [t for lang in langs for _, t in by_lang[lang][:landmarks_per_lang]]
    letters = np.array(sorted({ord(c) for t in marks for c in t.lower() if c.isalpha()}), np.int64)
    model = Model(langs, letters, None, None)
    table, size = model.table(), len(letters) + 1
    model.known = np.unique(np.concatenate([codes for t in marks for codes in _codes(_symbols(t, table), size)]))
    model.weights = np.zeros((len(model.known) + 1, len(langs)))
    unit = lambda p: p / np.sqrt(np.maximum(p.sum(axis=1, keepdims=True), 1.0))
    m = presence(marks, model, table).astype(np.float64)
    mark_truth = np.array([i for i, lang in enumerate(langs) for _ in by_lang[lang][:landmarks_per_lang]])
    first = np.unique(np.array(marks, object), return_index=True)[1]  # copies hold nothing of their own
    holders = m[first].T @ (mark_truth[first, None] == np.arange(len(langs)))
    foreign = (holders.sum(axis=1, keepdims=True) > holders).astype(np.float64)  # n-grams known without a language
    m, cross, apart = unit(m), [], []
    for i in range(0, len(texts), 256):
        p = presence(texts[i : i + 256], model, table).astype(np.float64)
        cross.append(unit(p) @ m.T)
        rest = (p @ foreign)[np.arange(len(p)), truth[i : i + 256]]
        apart.append(np.sqrt(np.maximum(p.sum(axis=1), 1.0) / np.maximum(rest, 1.0)))
    gram, cross, apart = m @ m.T, np.concatenate(cross), np.concatenate(apart)
    weights, model.bias = _solve(gram, cross, truth, len(langs), ridge)
    model.weights = m.T @ weights
    model.least_share, model.least_margin = _limits(texts, truth, marks, mark_truth, holders, gram, cross, apart, model, ridge)
    return model


def predict(df: DataFrame, model: Model, text_col: str = "text", lang_out: str = "lang_pred", score_out: str = "score", known_out: str | None = None) -> DataFrame:
    """Add the predicted language and a score from 0 to 1 (the winner's regression value,
    -1 to 1, moved there); with ``known_out`` also whether the
    text is in one of the languages."""
    import pyarrow as pa
    from pyspark.sql.types import BooleanType, DoubleType, StringType, StructField, StructType

    added = [lang_out, score_out, *([known_out] if known_out else [])]
    names = [c for c in df.columns if c not in added]
    schema = StructType([*(df.schema[c] for c in names), StructField(lang_out, StringType()), StructField(score_out, DoubleType()), *(StructField(c, BooleanType()) for c in added[2:])])
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        import numpy as np

        m = shared.value
        table = m.table()
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS_AT_ONCE):
                b = whole.slice(at, ROWS_AT_ONCE)
                texts = [t or "" for t in b.column(b.schema.get_field_index(text_col)).to_pylist()]
                lang, score, known = [UNKNOWN] * len(texts), [0.0] * len(texts), [False] * len(texts)
                if m.langs:
                    value = scores(texts, m, table) + m.bias
                    best = np.argmax(value, axis=1)
                    for i, t in enumerate(texts):
                        if LETTER.search(t):
                            lang[i] = m.langs[best[i]]
                            score[i] = float(min(1.0, max(0.0, (value[i, best[i]] + 1) / 2)))
                            if known_out:
                                margin = value[i, best[i]] - max((v for k, v in enumerate(value[i]) if k != best[i]), default=-math.inf)
                                known[i] = not m.in_none(t, margin, table)
                found = [pa.array(lang, pa.string()), pa.array(score, pa.float64()), *([pa.array(known, pa.bool_())] if known_out else [])]
                yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(c)) for c in names), *found], [*names, *added])

    return df.mapInArrow(run, schema)


def held_out(id_col: str = "doc_id"):
    """Whether crc32 of the id as text is 1 modulo 3; a null id is not."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))
