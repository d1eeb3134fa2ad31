"""Schemas of the tables that operators exchange; nothing is inferred."""

from __future__ import annotations

OP_LOG = "seq BIGINT, model_id INT, tid BIGINT, flag STRING, key BIGINT, val DOUBLE"
KV_STATE = "key BIGINT, val DOUBLE"
APPEND_LOG = "seq BIGINT, key BIGINT, val DOUBLE"
SAMPLE_LONG = "sample_id BIGINT, label INT, idx INT, x DOUBLE"
RATING = "pos BIGINT, user BIGINT, item BIGINT, rating INT"
WEIGHTS = "key BIGINT, val DOUBLE"
FACTORS = "row BIGINT, l INT, val DOUBLE"
TIMING = "iter INT, tid BIGINT, dur_us BIGINT"
WORKLOAD = "iter INT, tid BIGINT, workload INT"
STAT = "job_name STRING, stat_type STRING, iter INT, tid BIGINT, value DOUBLE"
IMAGE = "split STRING, idx INT, pixels ARRAY<SMALLINT>, label SMALLINT"
NODE = "id BIGINT, hostname STRING, port INT"
