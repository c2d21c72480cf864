"""Statements about topics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import log as L
from .base import query

query("topic_upsert", "SELECT name, topic_id FROM (SELECT topic AS name, topic_id FROM ends WHERE topic NOT IN ('click', 'zeta') AND topic_id NOT IN (1, 9) UNION ALL SELECT * FROM (VALUES ('click', 1), ('zeta', 9)))")(
    lambda s, d: (new := s.createDataFrame([("click", 1), ("zeta", 9)], "name string, topic_id long")) and L.topics(s, d).withColumnRenamed("topic", "name").join(new.select("name"), "name", "left_anti").join(new.select("topic_id"), "topic_id", "left_anti").select("name", "topic_id").union(new)
)
query("topic_drop", "SELECT topic, topic_id FROM ends WHERE topic <> 'view'")(lambda s, d: L.topics(s, d).where("topic <> 'view'"))
query("topic_ops_replay", "SELECT user_id AS topic_id, arg_max(event_type, event_id) AS name FROM events GROUP BY user_id HAVING arg_max(event_id % 3, event_id) <> 0", log=False)(lambda s, d: L.table(s, d, "events").groupBy(F.col("user_id").alias("topic_id")).agg(F.max_by("event_type", "event_id").alias("name"), F.max_by(F.col("event_id") % 3, "event_id").alias("op")).where("op <> 0").select("topic_id", "name"))
_CMD = " ".join(f"WHEN {k} THEN '{v}'" for k, v in S.COMMANDS.items())
query("command_names", f"SELECT code, CASE code {_CMD} ELSE 'ErrorResponse' END AS name FROM (SELECT unnest(range(256)) AS code)", log=False)(lambda s, d: s.range(256).select(F.col("id").alias("code"), S.command_name(F.col("id")).alias("name")))
