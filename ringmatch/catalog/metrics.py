"""Metric log, best-so-far, macro recall, contrastive diagnostics."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ringmatch.catalog import fixtures as X
from ringmatch.catalog import sql as S
from ringmatch.catalog.registry import query
from ringmatch.functions.vectors import quantise
from ringmatch.operators import contrast, recall, selection
from ringmatch.operators.index import blocked_row_number
from ringmatch.plans.selection import incomplete_validations, select_best
from ringmatch.session import scratch_path
from ringmatch.sources import logs
from ringmatch.streaming import best
from ringmatch.streaming import validations as stream_validations

SIMPLE_SCHEMA = T.StructType(
    [
        T.StructField("batch_kind", T.StringType()),
        T.StructField("epoch", T.LongType()),
        T.StructField("joint_in_batch_accuracy", T.DoubleType()),
        T.StructField("k", T.LongType()),
        T.StructField("loss", T.DoubleType()),
        T.StructField("record_type", T.StringType()),
        T.StructField("run", T.StringType()),
        T.StructField("step", T.LongType()),
    ]
)

LOG_SQL = """
log AS (
  SELECT 'run-' || user_id AS run, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS step,
         event_type AS record_type, value AS loss, CAST(json_extract(props, '$.k') AS BIGINT) AS k,
         event_id, ts FROM events),
numbered AS (SELECT *, step // 16 AS epoch, CASE WHEN k < 25 THEN 'hard' ELSE 'normal' END AS batch_kind,
                    k / 100.0::DOUBLE AS joint_in_batch_accuracy FROM log)"""


def settled(value):
    """Fixed-point average whose rounding step is off the round fractions that averages hit."""
    return F.floor(value * 1000000.0 + 0.5001).cast("bigint")


def settled_sql(expression: str) -> str:
    return f"CAST(floor(({expression}) * 1000000.0::DOUBLE + 0.5001::DOUBLE) AS BIGINT)"


def metric_log(spark, sf):
    """Events as log records; the step is the record's place in its run."""
    events = X.table(spark, sf, "events")
    minute = (F.unix_date(F.to_date("ts")) * 24 + F.hour("ts")) * 60 + F.minute("ts")
    numbered = blocked_row_number(events, ["ts", "event_id"], minute, ["user_id"], name="step")
    k = F.from_json("props", "k bigint")["k"]
    step = F.col("step").cast("bigint")
    return numbered.select(
        F.concat(F.lit("run-"), F.col("user_id").cast("string")).alias("run"),
        step.alias("step"),
        F.floor(step / 16).cast("bigint").alias("epoch"),
        F.col("event_type").alias("record_type"),
        F.col("value").alias("loss"),
        k.alias("k"),
        F.when(k < 25, "hard").otherwise("normal").alias("batch_kind"),
        (k / 100.0).alias("joint_in_batch_accuracy"),
        "event_id",
        "ts",
    )


def cents(column="loss"):
    return F.round(F.col(column) * 100).cast("bigint")


CENTS = "CAST(round(loss * 100) AS BIGINT)"


@query(
    "s7_metric_log",
    f"WITH {LOG_SQL} SELECT run, step, epoch, record_type, {CENTS} AS loss_cents, k, batch_kind FROM numbered",
)
def s7_metric_log(spark, sf):
    path = scratch_path(spark, "log")
    records = metric_log(spark, sf).drop("event_id", "ts")
    for kind in ("record_type IN ('click', 'view')", "record_type NOT IN ('click', 'view')"):
        logs.append_log(records.filter(kind), path)
    back = logs.read_log(spark, path, SIMPLE_SCHEMA)
    return back.select("run", "step", "epoch", "record_type", cents().alias("loss_cents"), "k", "batch_kind")


@query(
    "a16_step_rollup",
    f"""WITH {LOG_SQL} SELECT run, epoch, record_type, count(*) AS records, {settled_sql("avg(loss)")} AS mean_loss_q,
    CAST(round(arg_max(loss, step) * 100) AS BIGINT) AS latest_cents, {settled_sql("avg(joint_in_batch_accuracy)")} AS mean_accuracy_q,
    count(*) FILTER (WHERE batch_kind = 'hard') AS hard_batches, count(*) FILTER (WHERE batch_kind = 'normal') AS normal_batches
    FROM numbered GROUP BY run, epoch, record_type""",
)
def a16_step_rollup(spark, sf):
    rollup = selection.step_rollup(metric_log(spark, sf))
    return rollup.select(
        "run",
        "epoch",
        "record_type",
        "records",
        settled(F.col("mean_loss")).alias("mean_loss_q"),
        cents("latest_loss").alias("latest_cents"),
        settled(F.col("mean_accuracy")).alias("mean_accuracy_q"),
        "hard_batches",
        "normal_batches",
    )


@query(
    "a16_fov_totals",
    f"""WITH {LOG_SQL}, f AS (SELECT run, epoch, 360 AS fov, k % 5 AS n FROM numbered WHERE record_type <> 'view'
        UNION ALL SELECT run, epoch, 70, 3 FROM numbered WHERE record_type <> 'view' AND k % 2 = 0)
    SELECT run, epoch, CAST(fov AS BIGINT) AS fov_deg, CAST(sum(n) AS BIGINT) AS rows FROM f GROUP BY ALL""",
)
def a16_fov_totals(spark, sf):
    """Rows per FoV of the step records in a written log; records of other kinds do not count."""
    both = F.create_map(F.lit("360"), F.col("k") % 5, F.lit("70"), F.lit(3).cast("bigint"))
    one = F.create_map(F.lit("360"), F.col("k") % 5)
    kind = F.when(F.col("record_type") == "view", "validation").otherwise("train_step")
    records = metric_log(spark, sf).select(
        "run", "epoch", "step", kind.alias("record_type"), F.when(F.col("k") % 2 == 0, both).otherwise(one).alias("fov_counts")
    )
    path = scratch_path(spark, "log")
    logs.append_log(records, path)
    return selection.fov_totals(logs.read_log(spark, path))


@query(
    "w10_best_so_far",
    f"""WITH {LOG_SQL}, p AS (SELECT run, step, loss, max(loss) OVER (PARTITION BY run ORDER BY step
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM numbered)
    SELECT run, step, {CENTS} AS loss_cents, coalesce(CAST(round(prev * 100) AS BIGINT), -1) AS previous_cents,
           prev IS NULL OR loss > prev AS new_best FROM p""",
)
def w10_best_so_far(spark, sf):
    marked = selection.mark_new_best(metric_log(spark, sf), "loss", order="step")
    previous = F.coalesce(cents("previous_best"), F.lit(-1).cast("bigint"))
    return marked.select("run", "step", cents().alias("loss_cents"), previous.alias("previous_cents"), "new_best")


BEST_SQL = f"""WITH {LOG_SQL} SELECT run, CAST(round(max(loss) * 100) AS BIGINT) AS best_cents,
    arg_min(step, (-loss, step)) AS best_step FROM numbered GROUP BY run"""


@query("t1_streaming_best", BEST_SQL)
def t1_streaming_best(spark, sf):
    path, state = scratch_path(spark, "log"), scratch_path(spark, "state")
    records = metric_log(spark, sf).drop("event_id", "ts")
    for part in range(3):
        logs.append_log(records.filter(F.col("k") % 3 == part), path)
    stream = logs.stream_log(spark, path, SIMPLE_SCHEMA, files_per_trigger=4)
    best.start_best_stream(stream, "loss", state, scratch_path(spark, "stream"), order="step").awaitTermination()
    return best.read_best(spark, state, "loss", order="step").select(
        "run", cents("best_loss").alias("best_cents"), "best_step"
    )


MACRO_SQL = f"""{LOG_SQL},
recalls AS (SELECT run, epoch, CASE event_id % 4 WHEN 0 THEN 360 WHEN 1 THEN 180 WHEN 2 THEN 90 ELSE 70 END AS fov_deg,
                   max(loss) / 500 AS r1 FROM numbered GROUP BY ALL),
macro AS (SELECT run, epoch, (max(r1) FILTER (WHERE fov_deg = 360) + max(r1) FILTER (WHERE fov_deg = 180)
                 + max(r1) FILTER (WHERE fov_deg = 90) + max(r1) FILTER (WHERE fov_deg = 70)) / 4 AS macro,
                 count(*) AS n FROM recalls GROUP BY run, epoch)"""


def recalls(spark, sf):
    fov = F.element_at(X.fov_list(X.CROP_FOVS), (F.col("event_id") % 4 + 1).cast("int"))
    log = metric_log(spark, sf).withColumn("fov_deg", fov)
    return log.groupBy("run", "epoch", "fov_deg").agg((F.max("loss") / 500).alias("recall_at_1"))


@query(
    "a10_macro_recall",
    f"""WITH {MACRO_SQL} SELECT run, epoch, {settled_sql("coalesce(macro, -1)")} AS macro_q, n AS fov_rows, n = 4 AS complete
    FROM macro""",
)
def a10_macro_recall(spark, sf):
    macro = recall.macro_recall(recalls(spark, sf), X.CROP_FOVS, ["run", "epoch"])
    value = F.coalesce("macro_recall", F.lit(-1.0))
    return macro.select("run", "epoch", settled(value).alias("macro_q"), "fov_rows", "complete")


@query(
    "e5_select_best",
    f"""WITH {MACRO_SQL} SELECT run, {settled_sql("max(macro)")} AS best_macro_q, arg_min(epoch, (-macro, epoch)) AS best_epoch
    FROM macro WHERE n = 4 GROUP BY run""",
)
def e5_select_best(spark, sf):
    chosen = select_best(spark, validation_log(spark, sf), X.CROP_FOVS, skip_incomplete=True)
    return chosen.select("run", settled(F.col("best_macro_recall")).alias("best_macro_q"), "best_epoch")


@query(
    "t1_streaming_validations",
    f"""WITH {MACRO_SQL} SELECT run, {settled_sql("max(macro)")} AS best_macro_q, arg_min(epoch, (-macro, epoch)) AS best_epoch
    FROM macro WHERE n = 4 GROUP BY run""",
)
def t1_streaming_validations(spark, sf):
    """Validations whose FoVs arrive one by one, in three appends of the log."""
    path, state = scratch_path(spark, "log"), scratch_path(spark, "state")
    fovs = F.create_map(F.col("fov_deg").cast("string"), F.create_map(F.lit("R@1"), F.col("recall_at_1")))
    records = recalls(spark, sf).select("run", "epoch", F.lit("validation").alias("record_type"), fovs.alias("fovs"))
    for part in range(3):
        logs.append_log(records.filter(F.pmod(F.xxhash64("run", "epoch", F.col("fovs").cast("string")), F.lit(3)) == part), path)
    stream = logs.stream_log(spark, path, files_per_trigger=4)
    stream_validations.start_validation_stream(stream, X.CROP_FOVS, state, scratch_path(spark, "stream")).awaitTermination()
    chosen = stream_validations.read_best_validations(spark, state)
    return chosen.select("run", settled(F.col("best_macro_recall")).alias("best_macro_q"), "best_epoch")


@query("e5_incomplete_validations", f"WITH {MACRO_SQL} SELECT run, epoch, n AS fov_rows FROM macro WHERE n <> 4")
def e5_incomplete_validations(spark, sf):
    return incomplete_validations(spark, validation_log(spark, sf), X.CROP_FOVS)


def validation_log(spark, sf):
    path = scratch_path(spark, "log")
    rows = recalls(spark, sf).groupBy("run", "epoch").agg(
        F.map_from_entries(
            F.collect_list(
                F.struct(F.col("fov_deg").cast("string"), F.create_map(F.lit("R@1"), F.col("recall_at_1")))
            )
        ).alias("fovs")
    )
    logs.append_log(rows.withColumn("record_type", F.lit("validation")), path)
    return path


BATCH = 50
A11_SQL = f"""WITH {S.QUERIES},{S.ROTATED},
side AS (SELECT query_id, vec_id // {BATCH} AS batch, v, list_transform(v, lambda x, i: CASE WHEN (i - 1) % 8 >= 4 THEN x ELSE 0.0::DOUBLE END) AS vo,
         nv FROM queries WHERE fov_deg = CASE vec_id % 4 WHEN 0 THEN 360 WHEN 1 THEN 180 WHEN 2 THEN 90 ELSE 45 END),
tiles AS (SELECT gid, k, rv, CAST(gid AS BIGINT) // {BATCH} AS batch FROM rotated),
m AS (SELECT batch, query_id AS i, gid AS j, max(list_inner_product(v, rv) / nv) AS s, max(list_inner_product(vo, rv) / nv) AS o
      FROM side JOIN tiles USING (batch) GROUP BY ALL),
stacked AS (SELECT batch, i, j, 'joint' AS kind, s FROM m UNION ALL SELECT batch, i, j, 'order', o FROM m),
n AS (SELECT *, s / 0.07::DOUBLE - ln(sum(exp(s / 0.07::DOUBLE)) OVER (PARTITION BY kind, batch, i)) AS lr,
             s / 0.07::DOUBLE - ln(sum(exp(s / 0.07::DOUBLE)) OVER (PARTITION BY kind, batch, j)) AS lc,
             row_number() OVER (PARTITION BY kind, batch, i ORDER BY s DESC, j) AS place FROM stacked),
losses AS (SELECT batch, kind, count(DISTINCT i) AS rows,
      0.5::DOUBLE * (-0.9::DOUBLE * avg(CASE WHEN i = j THEN lr END) - 0.1::DOUBLE * avg(lr)
           - 0.9::DOUBLE * avg(CASE WHEN i = j THEN lc END) - 0.1::DOUBLE * avg(lc)) AS loss,
      avg(CASE WHEN place = 1 THEN CASE WHEN i = j THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END END) AS acc FROM n GROUP BY batch, kind)
SELECT a.batch, a.rows, {S.q("a.loss")} AS joint_q, {S.q("b.loss")} AS order_q, {S.q("a.loss + 0.15::DOUBLE * b.loss")} AS total_q,
       {S.q("a.acc")} AS joint_accuracy_q, {S.q("b.acc")} AS order_accuracy_q
FROM losses a JOIN losses b ON a.batch = b.batch AND a.kind = 'joint' AND b.kind = 'order'"""


@query("a11_contrastive_diagnostics", A11_SQL)
def a11_contrastive_diagnostics(spark, sf):
    """Planned batches of 50 rows with all FoVs in turn, so that masks differ inside a batch."""
    fov = F.element_at(X.fov_list(X.BIN_FOVS), (F.col("vec_id") % 4 + 1).cast("int"))
    queries = X.queries(spark, sf).filter(F.col("fov_deg") == fov)
    tiles = X.gallery(spark, sf).select(F.col("id").alias("positive_id"), F.col("direction").alias("tile"))
    rows = queries.join(tiles, "positive_id").select(
        F.floor(F.col("vec_id") / BATCH).cast("bigint").alias("batch"),
        (F.col("vec_id") % BATCH).alias("position"),
        "direction",
        "valid",
        "tile",
    )
    out = contrast.contrastive_diagnostics(rows, X.BINS, X.CHANNELS, 4, block_rows=32)
    names = {"joint_loss": "joint_q", "order_loss": "order_q", "total_loss": "total_q"}
    names |= {"joint_accuracy": "joint_accuracy_q", "order_accuracy": "order_accuracy_q"}
    return out.select("batch", "rows", *[quantise(F.col(c)).alias(n) for c, n in names.items()])
