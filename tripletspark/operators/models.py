"""Batch application of user models: chains of text steps, reviews, embeddings.

A model is any callable on a list; it runs inside executors over Arrow batches. All steps of
a row happen in one pass, so a model that is not deterministic is asked once per row and
step; write the result to a table before using it twice.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tripletspark.functions.text import (
    failed_verdict, judge_messages, parse_judgement, truncate_chars,
)
from tripletspark.functions.vectors import sanitize_vectors
from tripletspark.operators.similarity import to_matrix

Messages = list[dict]
TextModel = Callable[[list[Messages]], list[str]]



@dataclass(frozen=True)
class Step:
    """One model step. With ``fields`` the template goes into one user message with
    ``{name}`` filled from the columns; otherwise it is the system message and
    ``input_col`` the user message. ``runs`` > 1 feeds the output back as input."""
    template: str
    input_col: str
    output_col: str
    fields: Mapping[str, str] | None = None
    runs: int = 1


def _fill(template: str, values: Mapping[str, str]) -> str:
    out, at = [], 0
    while at < len(template):
        spots = [(p, n) for n in values if (p := template.find("{" + n + "}", at)) >= 0]
        if not spots:
            break
        p, name = min(spots)
        out += [template[at:p], values[name]]
        at = p + len(name) + 2
    return "".join([*out, template[at:]])


def _messages(step: Step, row: Mapping[str, object], source: str) -> Messages:
    def text(c: str) -> str:
        value = row.get(c)
        return "" if value is None else str(value)

    if step.fields:
        values = {n: text(source if c == step.input_col else c) for n, c in step.fields.items()}
        return [{"role": "user", "content": _fill(step.template, values)}]
    return [{"role": "system", "content": step.template}, {"role": "user", "content": text(source)}]


def apply_chain(df: DataFrame, steps: Sequence[Step], make_model: Callable[[], TextModel],
                batch: int = 8) -> DataFrame:
    """Run the steps in order; each adds ``output_col``, which later steps may read.

    ``make_model`` is called once per task. A batch whose call fails keeps its rows with
    ``status = 'failed'`` and the error, and null outputs from that step on, so that a rerun
    finds them not done.
    """
    if batch < 1 or not steps or any(s.runs < 1 for s in steps):
        raise ValueError("need at least one step, one run per step and a batch of one")
    new_cols = list(dict.fromkeys(s.output_col for s in steps))
    kept = [f for f in df.schema.fields if f.name not in new_cols]
    schema = T.StructType([*kept, *[T.StructField(c, T.StringType()) for c in new_cols],
                           T.StructField("status", T.StringType()),
                           T.StructField("error", T.StringType())])
    needed = [c for c in df.columns if c in
              {s.input_col for s in steps} | {c for s in steps for c in (s.fields or {}).values()}]

    def answer_batch(model: TextModel, rows: list[dict]) -> str | None:
        """Add the outputs to the rows; the error text when a call fails."""
        for step in steps:
            source = step.input_col
            for _ in range(step.runs):
                try:
                    answers = model([_messages(step, r, source) for r in rows])
                    if len(answers) != len(rows):
                        raise ValueError("model must answer once per item")
                except Exception as e:  # noqa: BLE001 - user code; reported per row
                    for r in rows:
                        r[step.output_col] = None
                    return f"{step.output_col}: {e}"
                for r, a in zip(rows, answers, strict=True):
                    r[step.output_col] = a
                source = step.output_col
        return None

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = make_model()
        for frame in frames:
            given = {c: [None if v is None or v is pd.NaT or v != v else v for v in frame[c]]
                     for c in needed}
            rows = [{c: given[c][i] for c in needed} for i in range(len(frame))]
            errors: list[str | None] = []
            for at in range(0, len(rows), batch):
                part = rows[at:at + batch]
                errors += [answer_batch(model, part)] * len(part)
            for c in new_cols:
                frame[c] = [r.get(c) for r in rows]
            frame["status"] = ["ok" if e is None else "failed" for e in errors]
            frame["error"] = errors
            yield frame[schema.names]

    return df.mapInPandas(run, schema)


def done_rows(results: DataFrame, key: str) -> DataFrame:
    """Keys that need no rerun; failed rows are not among them."""
    return results.filter("status = 'ok'").select(key)


def judge(df: DataFrame, kinds: Sequence[str], make_model: Callable[[], TextModel],
          code_col: str = "code_snippet", batch: int = 4) -> DataFrame:
    """Review every non-empty feedback column in ``kinds``: adds ``<kind>_validation``.

    A failing call gives a zero-score verdict that carries the error; an answer that is no
    JSON object one that says so; a column without text no verdict.
    """
    kinds = list(kinds)
    asked = df
    for kind in kinds:
        asked = asked.withColumn(f"_ask_{kind}", F.when(
            F.coalesce(F.col(kind), F.lit("")) != "",
            judge_messages(code_col, kind, kind)))
    answer = T.StructType([T.StructField("text", T.StringType()),
                           T.StructField("error", T.StringType())])
    schema = T.StructType([*df.schema.fields,
                           *[T.StructField(f"_got_{k}", answer) for k in kinds]])

    def ask(model: TextModel, messages: Messages) -> dict:
        try:
            return {"text": model([messages])[0], "error": None}
        except Exception as e:  # noqa: BLE001 - user code; reported per row
            return {"text": None, "error": str(e)}

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = make_model()
        for frame in frames:
            for kind in kinds:
                column = list(frame[f"_ask_{kind}"])
                todo = [i for i, m in enumerate(column) if m is not None]
                got: list[dict | None] = [None] * len(column)
                for at in range(0, len(todo), batch):
                    part = todo[at:at + batch]
                    messages = [[dict(x) for x in column[i]] for i in part]
                    try:
                        texts = model(messages)
                        if len(texts) != len(part):
                            raise ValueError("model must answer once per item")
                        answers = [{"text": t, "error": None} for t in texts]
                    except Exception:  # noqa: BLE001 - find the failing item
                        answers = [ask(model, m) for m in messages]
                    for i, a in zip(part, answers, strict=True):
                        got[i] = a
                frame[f"_got_{kind}"] = got
            yield frame[schema.names]

    answered = asked.mapInPandas(run, schema)
    for kind in kinds:
        got = F.col(f"_got_{kind}")
        verdict = (F.when(got.isNull(), None)
                   .when(got["error"].isNotNull(),
                         failed_verdict(F.concat(F.lit("Validation error: "), got["error"])))
                   .otherwise(parse_judgement(got["text"])))
        answered = answered.withColumn(f"{kind}_validation", verdict)
    return answered.drop(*[f"_got_{k}" for k in kinds])


# ------------------------------------------------------------------------- embeddings

def embed(df: DataFrame, text_col: str, make_encoder: Callable[[], Callable], *,
          batch: int = 32, normalize: bool = False, max_chars: int | None = None,
          out: str = "embedding") -> DataFrame:
    """Encode a text column with a user encoder: ``encoder(list[str]) -> n x d floats``.

    The encoder is made once per task and sees whole texts; ``max_chars`` is for models
    that take only so much.
    """
    schema = T.StructType([*df.schema.fields, T.StructField(out, T.ArrayType(T.FloatType()))])
    text = F.coalesce(text_col, F.lit(""))
    cut = df.withColumn("_text", truncate_chars(text, max_chars) if max_chars else text)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = make_encoder()
        for frame in frames:
            vectors: list = []
            texts = list(frame.pop("_text"))
            for at in range(0, len(texts), batch):
                m = np.asarray(encoder(texts[at:at + batch]), dtype=np.float32)
                if normalize:
                    length = np.linalg.norm(m, axis=1, keepdims=True)
                    m = np.divide(m, length, out=np.zeros_like(m), where=length > 0)
                vectors.extend(m)
            frame[out] = vectors
            yield frame[schema.names]

    return cut.mapInPandas(run, schema)


class _Slots(dict):
    """From a word to 2 * dimension + (1 for a negative sign), by its md5; emptied when large."""

    def __init__(self, dims: int, limit: int = 500_000):
        self.dims, self.limit = dims, limit

    def __missing__(self, word: str) -> int:
        if len(self) >= self.limit:
            self.clear()
        h = hashlib.md5(word.encode()).hexdigest()
        out = self[word] = 2 * (int(h[:8], 16) % self.dims) + (int(h[8], 16) >= 8)
        return out

    def of(self, text: str | None) -> np.ndarray:
        words = _WORD.findall((text or "").lower())
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words))


_WORD = re.compile(r"\w+")


def embed_default(df: DataFrame, text_col: str, *, dims: int = 256,
                  out: str = "embedding") -> DataFrame:
    """Encoder without a model: signed hashed words, inverse document frequency, unit length.

    A word's md5 gives its dimension (first 8 hex digits) and sign (the ninth); a dimension that
    df of N texts hit weighs ln((N + 1) / (df + 1)). Whole texts are read, twice: tasks first count
    their texts by dimension (``dims`` numbers each, added up), then write the vectors where the
    texts lie. Texts without words, null ones too, are zero vectors.
    """
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots, hit, n = _Slots(dims), np.zeros(dims, np.int64), 0
        for batch in batches:
            for text in batch.column(0).to_pylist():
                hit[np.unique(slots.of(text) >> 1)] += 1
            n += batch.num_rows
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(-1, dims, dtype=np.int64)), pa.array(np.r_[n, hit])],
            names=["dim", "n"])

    counts = {r.dim: r.n for r in df.select(F.col(text_col).cast("string"))
              .mapInArrow(count, "dim long, n long").groupBy("dim")
              .agg(F.sum("n").alias("n")).collect()}  # dims + 1 rows
    rows = counts.get(-1, 0)
    idf = np.log((rows + 1) / (np.array([counts.get(d, 0) for d in range(dims)]) + 1))
    schema = T.StructType([*df.schema.fields, T.StructField(out, T.ArrayType(T.FloatType()))])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots = _Slots(dims)
        for batch in batches:
            m = np.zeros((batch.num_rows, dims))
            for i, text in enumerate(batch.column(batch.num_columns - 1).to_pylist()):
                at = slots.of(text)
                m[i] = np.bincount(at >> 1, weights=1.0 - 2 * (at & 1), minlength=dims) * idf
            length = np.linalg.norm(m, axis=1, keepdims=True)
            unit = np.divide(m, length, out=np.zeros_like(m), where=length > 0)
            vectors = pa.ListArray.from_arrays(
                pa.array(np.arange(0, m.size + 1, dims, dtype=np.int32)),
                pa.array(unit.astype(np.float32).ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], vectors], names=schema.names)

    return df.withColumn("_text", F.col(text_col).cast("string")).mapInArrow(encode, schema)


def embed_distinct(df: DataFrame, text_col: str, encode: Callable[[DataFrame], DataFrame],
                   out: str = "embedding") -> DataFrame:
    """Encode each distinct text once and join the vectors back."""
    from tripletspark.operators.quality import text_digest
    keyed = df.withColumn("_d", text_digest(text_col))
    texts = keyed.groupBy("_d").agg(F.first(text_col).alias(text_col))
    return keyed.join(encode(texts).select("_d", out), "_d").drop("_d")


def second_moments(df: DataFrame, vec: str) -> tuple[int, np.ndarray, np.ndarray]:
    """Number, mean and covariance of the vectors in one pass: a task hands on one packed row, rows
    are added up in two steps, and one of dims * (dims + 1) numbers reaches the driver."""
    def accumulate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gram = total = None
        n = 0
        for batch in batches:
            if batch.num_rows:
                x = to_matrix(batch.column(0))
                gram = x.T @ x if gram is None else gram + x.T @ x
                total = x.sum(axis=0) if total is None else total + x.sum(axis=0)
                n += len(x)
        if gram is not None:
            yield pa.RecordBatch.from_pydict(
                {"packed": [np.concatenate([[float(n)], total, gram.ravel()])]})

    parts = df.select(vec).mapInArrow(accumulate, "packed array<double>")
    for slot in (F.spark_partition_id() % 64, F.lit(0)):
        parts = (parts.groupBy(slot.alias("slot"))
                 .agg(Summarizer.sum(array_to_vector("packed")).alias("s"))
                 .select(vector_to_array("s").alias("packed")))
    row = parts.first()
    if row is None:
        return 0, np.zeros(0), np.zeros((0, 0))
    n, x = int(row.packed[0]), np.array(row.packed[1:])
    dims = math.isqrt(len(x))
    mean = x[:dims] / n
    return n, mean, x[dims:].reshape(dims, dims) / n - np.outer(mean, mean)


def principal_axes(covariance: np.ndarray, k: int) -> tuple[np.ndarray, list[float]]:
    """The k axes of largest variance (rows) and their shares. An axis points to where its entry
    of largest size (of equal ones the first) is positive."""
    values, vectors = np.linalg.eigh(covariance)
    axes = vectors[:, ::-1][:, :k].T
    top = np.argmax(np.round(np.abs(axes), 12), axis=1)
    axes = axes * np.sign(axes[np.arange(len(axes)), top])[:, None]
    total = float(np.trace(covariance))
    return axes, [float(max(v, 0.0) / total) if total > 0 else 0.0 for v in values[::-1][:k]]


def project(df: DataFrame, dims: int = 2, *, vec: str = "embedding",
            out: str = "coords") -> tuple[DataFrame, list[float]]:
    """(rows with ``dims`` principal-component coordinates around the mean, explained variance
    shares). Signs are fixed by ``principal_axes``; NaN and infinities count as 0."""
    n, mean, covariance = second_moments(df, vec)
    if n == 0:
        return df.withColumn(out, F.array().cast("array<double>")), []
    if not 1 <= dims <= len(mean):
        raise ValueError("dims must be between 1 and the vectors' length")
    axes, shares = principal_axes(covariance, dims)
    x = sanitize_vectors(vec)

    def along(axis: np.ndarray) -> Column:
        parts = F.zip_with(x, F.lit([float(a) for a in axis]), lambda a, b: a * b)
        return F.aggregate(parts, F.lit(-float(mean @ axis)), lambda total, y: total + y)
    return df.withColumn(out, F.array(*[along(a) for a in axes])), shares


def mean_pool(df: DataFrame, group_cols: Sequence[str], vec: str = "embedding",
              weight: str | None = None, out: str = "embedding") -> DataFrame:
    """Weighted mean vector per group; the total weight is floored at 1e-9."""
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    scaled = F.transform(F.col(vec).cast("array<double>"), lambda x: x * F.col("_w"))
    parts = (df.withColumn("_w", w).withColumn("_v", array_to_vector(scaled))
             .groupBy(*group_cols)
             .agg(Summarizer.sum(F.col("_v")).alias("_s"), F.sum("_w").alias("_t")))
    floor = F.greatest(F.col("_t"), F.lit(1e-9))
    return parts.select(*group_cols, F.transform(
        vector_to_array("_s"), lambda x: x / floor).alias(out))
