"""Queries of scoring: models as documents, generated text, streams."""

from __future__ import annotations

import uuid
from dataclasses import replace

from pyspark.sql import functions as F

from timberline.operators.tree import Node, Tree
from timberline.plans import codegen
from timberline.plans.durable import shared_dir
from timberline.plans.learning import F_SQL, FOREST, LEAVES_SQL, depth2
from timberline.plans.registry import query, table
from timberline.sources.document import from_document, to_document
from timberline.sources.model import Model
from timberline.streaming import scoring

EVENT_TREE = Tree({1: Node(0, fid=0, column="value", split=50.0), 2: Node(-0.75), 3: Node(0, fid=1, column="event_type", kind="cat", split=0.0, right_codes=[0]), 6: Node(0.25), 7: Node(1.5)})
EVENT_MODEL = Model([EVENT_TREE], "keep", "leave", {"event_type": ["click", None]})
EVENT_SQL = "select event_id, round(cast(1 / (1 + exp(-2 * (case when coalesce(value, 0) > 50 then case when event_type = 'click' then 1.5 else 0.25 end else -0.75 end))) as double), 6) p from events"


def _sink(stream, name: str):
    """Runs a stream over what is there, into a table of the shared folder."""
    spark, at = stream.sparkSession, f"{shared_dir(stream.sparkSession)}/timberline/{name}-{uuid.uuid4().hex}"
    stream.writeStream.format("parquet").option("path", f"{at}/rows").option("checkpointLocation", f"{at}/progress").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{at}/rows")


@query("score_events_batch", EVENT_SQL)
def score_events_batch(spark, sf_dir):
    return EVENT_MODEL.score(table(spark, sf_dir, "events")).select("event_id", F.round("score", 6).alias("p"))


@query("score_events_stream", EVENT_SQL)
def score_events_stream(spark, sf_dir):
    rows = scoring.files(spark.readStream, table(spark, sf_dir, "events").schema, f"{sf_dir}/events.parque*")
    return _sink(scoring.score_stream(rows, EVENT_MODEL).select("event_id", F.round("score", 6).alias("p")), "scored-events")


@query("score_generated_sql", f"select c_custkey, round(cast(1 / (1 + exp(-2 * ({F_SQL}))) as double), 6) p from customer")
def score_generated_sql(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", F.round(F.expr(codegen.to_sql(Model(FOREST, "Y", "N"))), 6).alias("p"))


@query("score_model_document", f"select c_custkey, round(cast({F_SQL} as double), 6) p from customer")
def score_model_document(spark, sf_dir):
    """A regression that went through its JSON document."""
    return Model.from_json(Model(FOREST).to_json()).score(table(spark, sf_dir, "customer")).select("c_custkey", F.round("score", 6).alias("p"))


@query("score_exchange_document", EVENT_SQL)
def score_exchange_document(spark, sf_dir):
    """A model that went through the document that evaluators exchange."""
    return from_document(to_document(EVENT_MODEL)).score(table(spark, sf_dir, "events")).select("event_id", F.round("score", 6).alias("p"))


@query("forest_feature_ids", f"{LEAVES_SQL} select cast(f as int) fid, count(*) leaves from (select f1 f from leaves union all select f2 from leaves where f2 is not null and f2 <> f1) p group by f")
def forest_feature_ids(spark, sf_dir):
    """Features of the tree grown on lineitem, with the leaves that they lead to."""
    t = depth2(spark, sf_dir)
    rows = [(f,) for _, _, ids in t.paths() for f in set(ids) & t.feature_ids()]
    return spark.createDataFrame(rows, "fid int").groupBy("fid").agg(F.count("*").alias("leaves"))


@query("forest_leaves", f"{LEAVES_SQL} select count(*) leaves, round(sum(gamma), 6) total from leaves")
def forest_leaves(spark, sf_dir):
    leaves = depth2(spark, sf_dir).leaves().values()
    return spark.createDataFrame([(len(leaves), round(sum(n.gamma for n in leaves), 6))], "leaves long, total double")


@query("model_longest_name", f"{LEAVES_SQL} select cast(max(length(case f when 0 then 'l_quantity' when 1 then 'l_discount' when 2 then 'l_tax' else 'l_linenumber' end)) as int) longest from (select f1 f from leaves union select f2 from leaves where f2 is not null) n")
def model_longest_name(spark, sf_dir):
    names = {0: "l_quantity", 1: "l_discount", 2: "l_tax", 3: "l_linenumber"}
    t = depth2(spark, sf_dir)
    m = Model([Tree({i: replace(n, column=names.get(n.fid)) for i, n in t.nodes.items()})])
    return spark.createDataFrame([(c,) for c in m.columns()], "n string").agg(F.max(F.length("n")).alias("longest"))
