"""Change events and jobs, in batch form: routing, deliveries, status by key."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.hashing import hmac_sha256
from tessera.functions.text import branch_of_ref, contains_any, missing_if_empty, non_blank

# Kinds of documents by priority, the rules that name them, actions, and lifetimes in seconds.
DOC_TYPES = ("readme", "architecture", "api", "onboarding")
API_WORDS = ("api", "route", "controller", "schema", "endpoint")
SYSTEM_WORDS = ("docker", "compose", "infra", "service", "worker", "queue")
SETUP_WORDS = ("package.json", "requirements.txt", "pyproject.toml", ".env")
PULL_REQUEST_ACTIONS = ("opened", "reopened", "synchronize")
PING = "ping"
STATUS_TTL, CHAT_TTL, DELIVERY_TTL = 86_400, 86_400, 172_800
MAX_ATTEMPTS, BACKOFF_MS, RETAINED = 3, 5000, 1000

PAYLOAD = """action string, ref string, after string, number long,
repository struct<clone_url:string,full_name:string,default_branch:string>,
commits array<struct<added:array<string>,modified:array<string>,removed:array<string>>>,
pull_request struct<merged:boolean,merge_commit_sha:string,base:struct<ref:string,repo:struct<clone_url:string>>,head:struct<ref:string,sha:string,repo:struct<clone_url:string>>>"""


def changed_files(commits: Column) -> Column:
    """All added, modified and removed paths, sorted and distinct."""
    paths = F.flatten(F.transform(commits, lambda c: F.concat(*(F.coalesce(c[k], F.array().cast("array<string>")) for k in ("added", "modified", "removed")))))
    return F.array_sort(F.array_distinct(non_blank(paths)))


def doc_types(paths: Column) -> Column:
    """Kinds of documents that changes of these paths affect, by priority; architecture if none."""
    low = F.transform(F.coalesce(paths, F.array().cast("array<string>")), F.lower)
    prose = F.exists(low, lambda p: p.endswith("readme") | p.endswith(".md") | F.contains(p, F.lit("docs/")))
    api = F.exists(low, lambda p: contains_any(p, API_WORDS))
    system = F.exists(low, lambda p: contains_any(p, SYSTEM_WORDS))
    setup = F.exists(low, lambda p: contains_any(p, SETUP_WORDS))
    found = F.array_compact(F.array(F.when(prose, "readme"), F.when(system | setup, "architecture"), F.when(api, "api"), F.when(prose | setup, "onboarding")))
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("architecture")))


def verified(deliveries: DataFrame, secret: str) -> DataFrame:
    """Deliveries whose signature is that of their body under the secret. Columns: signature, body (binary)."""
    return deliveries.where(F.col("signature") == F.concat(F.lit("sha256="), hmac_sha256(secret)("body")))


# What becomes of a delivery that is not taken.
NO_SECRET, BAD_SIGNATURE, NO_ID, BAD_PAYLOAD, ACCEPTED = "webhook_secret_missing", "invalid_webhook_signature", "missing_delivery", "invalid_payload", "accepted"


def verdict(deliveries: DataFrame, secret: str | None) -> Column:
    """ACCEPTED, or why not, of each delivery (signature, delivery_id, body): without a secret none is, then the signature, the id and the body (a JSON object) count in this order."""
    if not secret:
        return F.lit(NO_SECRET)
    signed = F.col("signature") == F.concat(F.lit("sha256="), hmac_sha256(secret)("body"))
    parsed = F.try_parse_json(F.col("body").cast("string"))
    whole = F.schema_of_variant(parsed).startswith("OBJECT")
    return F.when(~F.coalesce(signed, F.lit(False)), BAD_SIGNATURE).when(F.coalesce("delivery_id", F.lit("")) == "", NO_ID).when(~F.coalesce(whole, F.lit(False)), BAD_PAYLOAD).otherwise(ACCEPTED)


REQUEST_DEFAULTS = {"branch": "main"}


def job_requests(requests: DataFrame) -> DataFrame:
    """Job rows of requests (body: JSON): job_id, repository_url, branch, doc_types, trigger_event, trigger_action, commit_sha, metadata (JSON) and error.

    A field of another type than its own is as if it were absent: the URL is then missing, which is the error BAD_PAYLOAD, the branch main, lists and metadata empty and the
    others null. Names are trimmed. Elements of doc_types that are no strings are left out.
    """
    rows = requests.withColumn("_v", F.try_parse_json(F.col("body").cast("string")))

    def typed(name: str, kind: str, shape: str) -> Column:
        held = F.try_variant_get("_v", f"$.{name}", "variant")
        return F.when(F.schema_of_variant(held).startswith(kind), F.try_variant_get("_v", f"$.{name}", shape))

    def text(name: str) -> Column:
        return missing_if_empty(F.trim(typed(name, "STRING", "string")))

    whole = lambda name: typed(name, "STRING", "string")
    listed = F.transform(typed("docTypes", "ARRAY", "array<variant>"), lambda v: F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string")))
    held = F.try_variant_get("_v", "$.metadata", "variant")
    metadata = F.when(F.schema_of_variant(held).startswith("OBJECT"), F.to_json(held)).otherwise("{}")
    return rows.withColumns({
        "job_id": text("jobId"), "repository_url": text("repositoryUrl"), "branch": F.coalesce(text("branch"), F.lit(REQUEST_DEFAULTS["branch"])),
        "doc_types": F.coalesce(F.array_compact(listed), F.array().cast("array<string>")),
        "trigger_event": whole("triggerEvent"), "trigger_action": whole("triggerAction"), "commit_sha": whole("requestedCommitSha"), "metadata": metadata,
        "error": F.when(text("repositoryUrl").isNull(), BAD_PAYLOAD),
    }).drop("_v")


def route_events(events: DataFrame) -> DataFrame:
    """Jobs of push and pull-request events; other events, and those without a repository, give none.

    events: delivery_id, event, payload (JSON).
    """
    x = events.withColumn("p", F.from_json("payload", PAYLOAD))
    push, pull = F.col("event") == "push", F.col("event") == "pull_request"
    merged = pull & (F.col("p.action") == "closed") & F.col("p.pull_request.merged")
    head = pull & ~F.coalesce(merged, F.lit(False)) & F.col("p.action").isin(*PULL_REQUEST_ACTIONS)
    url = F.col("p.repository.clone_url")
    files = F.coalesce(changed_files(F.col("p.commits")), F.array().cast("array<string>"))
    jobs = x.where(push | merged | head).select(
        F.col("delivery_id").alias("job_id"),
        F.when(push, url).when(merged, F.coalesce(F.col("p.pull_request.base.repo.clone_url"), url)).otherwise(F.coalesce(F.col("p.pull_request.head.repo.clone_url"), url)).alias("repository_url"),
        F.when(push, branch_of_ref(F.coalesce("p.ref", F.lit(""))))
        .when(merged, F.coalesce(missing_if_empty(F.col("p.pull_request.base.ref")), F.col("p.repository.default_branch"), F.lit("main")))
        .otherwise(F.coalesce(missing_if_empty(F.col("p.pull_request.head.ref")), F.lit("main"))).alias("branch"),
        F.when(push, F.col("p.after")).when(merged, F.col("p.pull_request.merge_commit_sha")).otherwise(F.col("p.pull_request.head.sha")).alias("commit_sha"),
        F.when(push, doc_types(files)).when(merged, F.array(*map(F.lit, DOC_TYPES))).otherwise(F.array(F.lit("architecture"), F.lit("api"))).alias("doc_types"),
        F.col("event").alias("trigger_event"),
        F.when(push, "push").otherwise(F.col("p.action")).alias("trigger_action"),
        F.when(push, files).alias("changed_files"),
    )
    return jobs.where(F.coalesce("repository_url", F.lit("")) != "")


def dedupe_deliveries(deliveries: DataFrame, ttl: int = DELIVERY_TTL) -> DataFrame:
    """Each delivery with the event that answers it: the record stored for its id if that is younger than ttl seconds, else itself.

    A record lives from when it was stored, and a replay does not renew it. Where there is a column event, pings are
    answered by themselves and overwrite the record. deliveries: delivery_id, event_id, ts.

    Every row is answered once, whatever its event_id; without a delivery_id or a time it is answered by itself. Deliveries of an id are read in
    order, one row at a time: sorted within partitions, with the record as all that is held.
    """
    ping = F.col("event") == PING if "event" in deliveries.columns else F.lit(False)
    kind, place = dict(deliveries.dtypes)["event_id"], len(deliveries.columns)
    rows = deliveries.withColumns({"_at": F.unix_micros("ts"), "_ping": F.coalesce(ping, F.lit(False))})
    rows = rows.repartition("delivery_id").sortWithinPartitions("delivery_id", "_at", "event_id")
    schema = deliveries.select("*", F.lit(None).cast(kind).alias("answered_by"), F.lit(None).cast("boolean").alias("duplicate")).schema

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, stored, since = None, None, None
        for batch in batches:
            answers, copies = [], []
            for delivery, event, at, is_ping in zip(*(batch.column(c).to_pylist() for c in ("delivery_id", "event_id", "_at", "_ping"))):
                own = delivery is None or delivery != key or is_ping or at is None or since is None or at - since >= ttl * 1_000_000
                if own:
                    key, stored, since = delivery, event, at
                answers.append(stored)
                copies.append(not own)
            columns = [*batch.columns[:place], pa.array(answers, batch.schema.field("event_id").type), pa.array(copies, pa.bool_())]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names[:place], "answered_by", "duplicate"])

    return rows.mapInArrow(answer, schema)


def latest_status(updates: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Shallow merge of each key's updates in order (ts, event_id): of every field the last value that was given."""
    order = F.struct("ts", "event_id")
    return updates.groupBy(key).agg(*(F.max_by(f, F.when(F.col(f).isNotNull(), order)).alias(f) for f in fields))


def job_states(updates: DataFrame, key: str, attempts: int = MAX_ATTEMPTS) -> DataFrame:
    """State of each job after all its updates: failed from the last allowed error on unless completed afterwards."""
    order = F.struct("ts", "event_id")
    last = updates.groupBy(key).agg(
        F.max_by("status", order).alias("last"), F.count_if(F.col("status") == "retrying").cast("long").alias("errors"), F.count("*").alias("updates")
    )
    state = F.when((F.col("last") == "retrying") & (F.col("errors") >= attempts), "failed").otherwise(F.col("last"))
    return last.select(key, state.alias("state"), "errors", "updates")


# Percents and stages of a job's progress.
STAGES = ((5, "cloning"), (20, "metadata"), (35, "diffing"), (50, "parsing"), (90, "summarizing"), (95, "documentation"), (100, "completed"))


def progress_events(jobs: DataFrame) -> DataFrame:
    """job_id, progress and stage of every step of jobs (job_id, doc_types); the step for documentation only where doc_types has any."""
    steps = F.array(*(F.struct(F.lit(p).alias("progress"), F.lit(s).alias("stage")) for p, s in STAGES))
    rows = jobs.select("job_id", "doc_types", F.explode(steps).alias("x")).select("job_id", "x.*", "doc_types")
    return rows.where((F.col("stage") != "documentation") | (F.size("doc_types") > 0)).drop("doc_types")


def in_order(updates: DataFrame, key: str) -> DataFrame:
    """The updates without those that come after one of later (ts, event_id) in order of arrival (arrived)."""
    before = Window.partitionBy(key).orderBy("arrived").rowsBetween(Window.unboundedPreceding, -1)
    latest = F.max(F.struct("ts", "event_id")).over(before)
    return updates.withColumn("_latest", latest).where(F.col("_latest").isNull() | (F.struct("ts", "event_id") > F.col("_latest"))).drop("_latest")


def snapshot_and_changes(state: DataFrame, updates: DataFrame, key: str) -> DataFrame:
    """What a subscriber gets: the state of each key as of its last update in it, then the later updates. seq: 0 for the state.

    state: key, ts, event_id, status; an update is never lost between the two, as the state says what it has seen.
    """
    columns = [key, "ts", "event_id", "status"]
    seen = state.select(F.col(key), F.struct("ts", "event_id").alias("_seen"))
    later = updates.join(seen, key, "left").where(F.col("_seen").isNull() | (F.struct("ts", "event_id") > F.col("_seen"))).select(*columns)
    order = Window.partitionBy(key).orderBy("ts", "event_id")
    return state.select(*columns, F.lit(0).alias("seq")).unionByName(later.withColumn("seq", F.row_number().over(order)))


def with_live_state(jobs: DataFrame, state: DataFrame) -> DataFrame:
    """jobs (job_id, status) with the status of the live state where there is one."""
    live = state.select("job_id", F.col("status").alias("_live"))
    return jobs.join(live, "job_id", "left").withColumn("status", F.coalesce("_live", "status")).drop("_live")


def backoff_ms(attempt: Column, base: int = BACKOFF_MS) -> Column:
    return (F.lit(base) * F.pow(F.lit(2), attempt - 1)).cast("long")


def retries_due(updates: DataFrame, key: str, attempts: int = MAX_ATTEMPTS, base: int = BACKOFF_MS) -> DataFrame:
    """key, attempt and due_at of every retry that errors have scheduled by the time of the newest update: backoff_ms after an error that leaves an attempt, unless another update of the key comes earlier."""
    order = Window.partitionBy(key).orderBy("ts", "event_id")
    errors = F.count_if(F.col("status") == "retrying").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)).cast("int")
    placed = updates.select(key, "ts", "status", errors.alias("errors"), F.lead("ts").over(order).alias("_next")).where(F.col("status") == "retrying")
    due = F.timestamp_micros(F.unix_micros("ts") + backoff_ms(F.col("errors"), base) * 1000)
    newest = updates.agg(F.max("ts").alias("_now"))  # one row
    rows = placed.where(F.col("errors") < attempts).withColumn("due_at", due).join(F.broadcast(newest), F.lit(True))
    return rows.where((F.col("due_at") <= F.coalesce("_next", "_now"))).select(key, (F.col("errors") + 1).alias("attempt"), "due_at")


def retain_last(rows: DataFrame, by: str, n: int = RETAINED) -> DataFrame:
    w = Window.partitionBy(by).orderBy(F.desc("ts"), F.desc("event_id"))
    return rows.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_n")


def unexpired(rows: DataFrame, ttl: int = STATUS_TTL) -> DataFrame:
    newest = rows.agg(F.max("ts").alias("_now"))  # one row
    return rows.join(F.broadcast(newest), F.lit(True)).where(F.unix_timestamp("_now") - F.unix_timestamp("ts") < ttl).drop("_now")


def children_left(children: DataFrame, parents_gone: DataFrame, key: str) -> DataFrame:
    """The children that stay when parents are deleted, and theirs with them."""
    return children.join(parents_gone, key, "left_anti")


def all_up(*checks: DataFrame) -> DataFrame:
    """One row, ok: whether every check (up) holds."""
    rows = checks[0].select("up")
    for check in checks[1:]:
        rows = rows.unionByName(check.select("up"))
    return rows.agg(F.coalesce(F.bool_and("up"), F.lit(False)).alias("ok"))
