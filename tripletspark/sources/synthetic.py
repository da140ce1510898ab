"""Synthetic triplets that cycle through ten fixed patterns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tripletspark.functions.text import pseudonymize

# Fixed values: (code, feedback that fits, feedback that does not).
PATTERNS = (
    ("for (i = 0; i <= n; i++) s += a[i];", "The loop reads one element too many.",
     "The file is never closed."),
    ("char *p = malloc(8); p[0] = 1;", "The result of malloc is used unchecked.",
     "The loop never ends."),
    ("if (x = 3) return 1;", "An assignment stands where a comparison is meant.",
     "The buffer is too small."),
    ("int f(int n) { return n * f(n - 1); }", "The recursion has no base case.",
     "The variable is unused."),
    ("char b[4]; strcpy(b, \"hello\");", "The copy overruns the buffer.",
     "The recursion has no base case."),
    ("double sum; for (k = 0; k < m; k++) sum += w[k];", "The variable is read before it is set.",
     "The copy overruns the buffer."),
    ("while (i < 10) { s += i; }", "The loop variable never changes.",
     "The result of malloc is used unchecked."),
    ("FILE *f = fopen(p, \"r\"); fgetc(f);", "The file may not have been opened.",
     "The loop variable never changes."),
    ("free(p); p->next = q;", "Memory is used after it was freed.",
     "The file may not have been opened."),
    ("mean = total / count_lines(log);", "The divisor may be zero.", "Memory is used after it was freed."),
)


def triplets_for(df: DataFrame, i: Column | str) -> DataFrame:
    """One triplet per row, pattern number ``i % 10``; ids are a function of ``i``."""
    i = F.col(i) if isinstance(i, str) else i
    table = F.array(*[F.struct(
        F.lit(c).alias("code"), F.lit(p).alias("fit"), F.lit(n).alias("unfit"))
        for c, p, n in PATTERNS])
    picked = F.element_at(table, (F.pmod(i, F.lit(len(PATTERNS))) + 1).cast("int"))

    def uid(kind: str) -> Column:
        return pseudonymize(F.concat(F.lit(f"{kind}/"), F.col("i").cast("string")))

    code, fit, unfit = F.col("t.code"), F.col("t.fit"), F.col("t.unfit")
    return df.select(i.alias("i"), picked.alias("t")).select(
        uid("code").alias("code_id"), uid("author").alias("author_id"),
        code.alias("code_snippet"), fit.alias("generated_feedback"),
        fit.alias("refined_feedback"), unfit.alias("negative_feedback"),
        fit.alias("conceptual_feedback"), unfit.alias("hard_negative_feedback"),
        F.lit(0.3).alias("hard_negative_similarity"),
        uid("source").alias("hard_negative_source_id"), unfit.alias("llm_negative_feedback"))


def generate_triplets(spark: SparkSession, n: int) -> DataFrame:
    return triplets_for(spark.range(n), "id")
