"""Context of chunks: which need one, a prompt for model backends, an offline default.

A backend that fails or answers with fewer than LEAST_ANSWER characters is replaced by the default text for that chunk, so none is lost.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kbforge.operators.chunk import context_of, needs_context

LEAST_ANSWER = 10
# Fixed value: the prompt of model backends.
PROMPT = """<document>
{document}
</document>

Here is the chunk we want to situate within the whole document:
<chunk>
{chunk}
</chunk>

Please give a short succinct context to situate this chunk within the overall document for the purposes of improving search retrieval of the chunk. Answer only with the succinct context and nothing else."""
#: Options handed to model backends.
OPTIONS = {"temperature": 0.3, "num_predict": 100, "timeout": 30}


def contextualised(chunks: DataFrame, text: str = "text", path: str = "file_path", project: str = "project", generate: Callable[[str], str] | None = None, document: str | None = None) -> DataFrame:
    """Add needed, generated_context and contextual_chunk; generate maps a prompt to an answer and runs on the executors."""
    default = context_of(F.coalesce(path, F.lit("Unknown")), F.coalesce(project, F.lit("Unknown")))
    out = chunks.withColumn("needed", needs_context(F.col(text)))
    context = default
    if generate is not None:

        @F.pandas_udf("string")
        def answer(docs: pd.Series, parts: pd.Series, wanted: pd.Series) -> pd.Series:
            def one(d, c, w):
                if not w:
                    return None
                try:
                    x = (generate(PROMPT.format(document=d or "", chunk=c or "")) or "").strip()
                except Exception:
                    return None
                return x if len(x) >= LEAST_ANSWER else None

            return pd.Series([one(*x) for x in zip(docs, parts, wanted, strict=True)], dtype=object)

        context = F.coalesce(answer(F.col(document or text), F.col(text), F.col("needed")), default)
    out = out.withColumn("generated_context", F.when(F.col("needed"), context).otherwise(F.lit("")))
    joined = F.concat("generated_context", F.lit("\n\n"), F.col(text))
    return out.withColumn("contextual_chunk", F.when(F.col("needed"), joined).otherwise(F.col(text)))


