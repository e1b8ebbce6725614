"""External model: request bodies, batch calls through ``mapInPandas``, and
response parsing into assignments / failures."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as TT

from .. import constants as K

RESPONSE_SCHEMA = TT.StructType([
    TT.StructField("result", TT.StructType([
        TT.StructField("model", TT.StringType()),
        TT.StructField("confidence", TT.DoubleType()),
        TT.StructField("categories", TT.ArrayType(TT.StructType([
            TT.StructField("name", TT.StringType()),
            TT.StructField("confidence", TT.DoubleType()),
            TT.StructField("reasoning", TT.StringType()),
        ]))),
    ])),
    TT.StructField("error", TT.StructType([
        TT.StructField("code", TT.LongType()),
        TT.StructField("message", TT.StringType()),
    ])),
])


def requests(docs: DataFrame, content_col: str = "content", key: str = "_id") -> DataFrame:
    """JSON-RPC 2.0 ``tools/call`` body per document; nulls become ''. The
    request id is a hash of the document id (deterministic, replayable)."""
    args = F.struct(
        F.col(key).alias("documentId"),
        F.coalesce(F.col("title"), F.lit("")).alias("title"),
        F.coalesce(F.col("description"), F.lit("")).alias("description"),
        F.coalesce(F.col(content_col), F.lit("")).alias("content"))
    body = F.struct(
        F.lit("2.0").alias("jsonrpc"),
        F.sha2(F.col(key), 256).alias("id"),
        F.lit(K.MODEL_METHOD).alias("method"),
        F.struct(F.lit(K.MODEL_TOOL_NAME).alias("name"), args.alias("arguments")).alias("params"))
    return docs.select(F.col(key).alias("doc_id"), F.sha2(F.col(key), 256).alias("request_id"),
                       F.to_json(body).alias("request"))


def parse_responses(responses: DataFrame) -> DataFrame:
    return responses.select("doc_id", F.from_json(F.col("response"), RESPONSE_SCHEMA).alias("r"))


def predictions(responses: DataFrame) -> DataFrame:
    """Successful responses exploded to assignments, labelled ``mcp-<model>``
    (``mcp-ai`` when the model is null); ``pos`` keeps the list order."""
    p = parse_responses(responses).where(F.col("r.error").isNull() & F.col("r.result").isNotNull())
    label = F.concat(F.lit(K.MODEL_LABEL_PREFIX), F.coalesce(F.col("r.result.model"), F.lit("ai")))
    return (p.select("doc_id", label.alias("classifier"), F.posexplode(F.col("r.result.categories")).alias("pos", "c"))
            .select("doc_id", F.col("c.name").alias("name"), F.col("c.confidence").alias("confidence"),
                    "classifier", "pos"))


def failures(responses: DataFrame) -> DataFrame:
    p = parse_responses(responses)
    reason = (F.when(F.col("r.error").isNotNull(),
                     F.concat(F.lit("model error: "), F.coalesce(F.col("r.error.message"), F.lit(""))))
              .otherwise(F.lit("malformed response")))
    return (p.where(F.col("r.error").isNotNull() | F.col("r.result").isNull())
            .select("doc_id", reason.alias("reason")))


def call_model(request_frame: DataFrame,
               model_fn: Callable[[pd.DataFrame], pd.DataFrame]) -> DataFrame:
    """Send request batches to a caller-supplied model function.

    ``model_fn`` receives a pandas frame (doc_id, request) — one Arrow batch
    at a time, on the executors — and returns (doc_id, response)."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = model_fn(b[["doc_id", "request"]])
            yield out[["doc_id", "response"]]

    return request_frame.select("doc_id", "request").mapInPandas(run, "doc_id string, response string")


def length_model(batch: pd.DataFrame) -> pd.DataFrame:
    """Demonstration model: labels a request by the length of its body."""
    n = batch["request"].str.len()
    name = n.gt(4000).map({True: "Long Read", False: "Short Read"})
    conf = (n % 100 / 100.0).round(2).astype(str)
    resp = ('{"jsonrpc":"2.0","result":{"model":"length","categories":[{"name":"' + name
            + '","confidence":' + conf + ',"reasoning":"request length"}]}}')
    return pd.DataFrame({"doc_id": batch["doc_id"], "response": resp})
