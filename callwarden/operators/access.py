"""Authorization: mandates, leases, tools, resources, recipients, models, sinks, approvals and memory."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callwarden.functions.globs import glob_to_regex, hmac_sha256, matches_any
from callwarden.operators.decide import finding
from callwarden.operators.running import running
from callwarden.rules import policy as P
from callwarden.rules.feed import POISONED_TOOL_RULE
from callwarden.session import cut_lineage


def lookup(values: dict, key: Column, default=None) -> Column:
    """Value of a small constant map."""
    if not values:
        return F.lit(default)
    pairs = [x for k, v in values.items() for x in (F.lit(k), F.lit(v))]
    found = F.try_element_at(F.create_map(*pairs), key)
    return found if default is None else F.coalesce(found, F.lit(default))


# ---------------------------------------------------------------- mandates and leases


def resolve_mandates(tasks: DataFrame, profiles: DataFrame, params: str = "params") -> DataFrame:
    """Tasks with their mandate filled in from the profile, or the reason why there is none.

    ``params`` is a ``map<string,string>``; ``{name}`` in a glob is replaced by its value. Task profiles are
    configuration (one row per profile), so that side of the join is small by nature; Spark picks the join.
    """
    bad_param = F.exists(
        F.map_values(params), lambda v: ~F.regexp_replace(v, "[-_]", "").rlike(r"^[\p{L}\p{N}]+\z")
    )

    def fill(glob: Column) -> Column:
        return F.aggregate(
            F.map_entries(params), glob, lambda acc, e: F.replace(acc, F.concat(F.lit("{"), e["key"], F.lit("}")), e["value"])
        )

    known = profiles.withColumn("_known", F.lit(True))
    joined = tasks.join(known, "profile", "left")
    reason = F.when(F.col("_known").isNull(), "UNKNOWN_TASK_PROFILE").when(bad_param, "INVALID_PARAM")
    return joined.select(
        *tasks.columns,
        reason.alias("rejected"),
        *[F.when(reason.isNull(), F.transform(c, fill)).alias(c) for c in ("resources", "recipients_allow")],
        *[F.when(reason.isNull(), F.col(c)).alias(c) for c in ("tools", "models", "tokens", "calls", "concurrency")],
    )


def lease_signature(secret: bytes, task_id: Column, agent_id: Column, principal: Column, expires_at: Column) -> Column:
    seconds = F.unix_seconds(expires_at.cast("timestamp")).cast("string")
    return F.substring(hmac_sha256(secret, F.concat_ws("|", task_id, agent_id, principal, seconds)), 1, 32)


def check_leases(calls: DataFrame, tasks: DataFrame, secret: bytes) -> DataFrame:
    """Calls with ``lease_reason``: null when the lease is genuine, bound to the agent, active and not expired."""
    owner = tasks.select(
        F.col("id").alias("_task"), F.col("agent_id").alias("_agent"), F.col("status").alias("_status"),
        F.col("expires_at").alias("_expires"),
        lease_signature(secret, F.col("id"), F.col("agent_id"), F.col("principal"), F.col("expires_at")).alias("_sig"),
    )
    has_dot = F.coalesce(F.contains("lease", F.lit(".")), F.lit(False))
    work = calls.withColumn("_task", F.when(has_dot, F.substring_index("lease", ".", 1)))
    sent = F.substring(F.col("lease"), F.length("_task") + 2, F.length("lease"))
    reason = (
        F.when(~has_dot, "LEASE_REQUIRED")
        .when(F.col("_sig").isNull() | (sent != F.col("_sig")), "LEASE_INVALID")
        .when(F.col("_agent") != F.col("agent_id"), "LEASE_AGENT_MISMATCH")
        .when(F.col("_status") != "active", F.concat(F.lit("CAPABILITY_"), F.upper("_status")))
        .when(F.col("_expires") <= F.col("ts"), "CAPABILITY_EXPIRED")
    )
    return work.join(owner, "_task", "left").select(*calls.columns, reason.alias("lease_reason"))


# ---------------------------------------------------------------- single checks, as Columns


def tool_known(tool: Column) -> Column:
    return tool.isin(list(P.TOOLS))


def tool_finding(tool: Column, allowed: Column, enabled: Column | bool = True) -> Column:
    unknown = finding("BLOCK", "TOOL-UNKNOWN", "UNKNOWN_TOOL", "mandate", {"tool": tool})
    denied = finding("BLOCK", "MANDATE-TOOL", "TOOL_NOT_IN_MANDATE", "mandate",
                     {"tool": tool, "allowed": F.array_join(allowed, ",")})
    listed = F.coalesce(F.array_contains(allowed, tool), F.lit(False))
    return F.when(~tool_known(tool), unknown).when(F.lit(enabled) & ~listed, denied)


def resource_allowed(path: Column, regexes: Column) -> Column:
    return ~F.contains(path, F.lit("..")) & matches_any(path, regexes)


def recipient_allowed(address: Column, regexes_lower: Column) -> Column:
    return matches_any(F.lower(F.regexp_replace(address, r"(?U)^\s+|\s+\z", "")), regexes_lower)


def model_reason(model: Column, mandate_models: Column, allow: list[str] | None = None) -> Column:
    """MODEL-001 when the policy forbids the model, else MANDATE-MODEL when the mandate does (null list: any)."""
    globs = F.transform(F.array(*[F.lit(g) for g in (P.MODEL_ALLOW if allow is None else allow)]), glob_to_regex)
    return F.when(~matches_any(model, globs), "MODEL-001").when(
        mandate_models.isNotNull() & ~F.array_contains(mandate_models, model), "MANDATE-MODEL"
    )


def resolve_sink(tool: Column, to: Column, model: Column | None = None, internal_domains: list[str] | None = None,
                 providers: dict[str, str] | None = None) -> Column:
    """Where the content of a call goes: mail by recipient domain, prompts by model provider, else the tool."""
    domains = [d.lower() for d in (P.INTERNAL_DOMAINS if internal_domains is None else internal_domains)]
    domain = F.lower(F.substring_index(F.coalesce(to, F.lit("")), "@", -1))
    mail = F.when(domain.isin(domains), "mail.send:internal").otherwise("mail.send:external")
    sink = F.when(tool == "mail.send", mail).otherwise(tool)
    if model is None:
        return sink
    provider = F.substring_index(model, "/", 1)
    return F.when(
        model.isNotNull(), lookup(P.PROVIDER_SINKS if providers is None else providers, provider, "llm:external")
    ).otherwise(sink)


def sink_clearance(df: DataFrame, sinks: DataFrame, sink: str = "sink", narrowing: str | None = None) -> DataFrame:
    """Add ``clearance``: unknown sinks are PUBLIC, and a mandate may only narrow (``map<sink,level>``)."""
    known = sinks.select(F.col("sink").alias(sink), F.col("clearance").alias("_level"))
    out = df.join(known, sink, "left")
    level = F.coalesce("_level", F.lit(P.PUBLIC))
    if narrowing:
        level = F.least(level, F.try_element_at(F.col(narrowing), F.col(sink)))
    return out.withColumn("clearance", level.cast("int")).drop("_level")


def code_finding(tool: Column, enabled: Column | bool, mode: Column | str) -> Column:
    on = F.lit(enabled) if isinstance(enabled, bool) else enabled
    how = F.lit(mode) if isinstance(mode, str) else mode
    made = finding("BLOCK", "SBX-001", "CODE_EXECUTION_BLOCKED", "mandate", {"mode": F.when(on, how).otherwise("off")})
    return F.when((tool == "code.run") & (~on | (how == "block")), made)


def quarantine_finding(tool: Column, status: Column) -> Column:
    internal = [t for t, spec in P.TOOLS.items() if spec.get("internal")]
    made = finding("BLOCK", POISONED_TOOL_RULE, "TOOL_QUARANTINED", "signatures", {"tool": tool})
    return F.when(tool_known(tool) & ~tool.isin(internal) & (status == "quarantined"), made)


def visible_tools(tasks: DataFrame, registry: DataFrame) -> DataFrame:
    """(id, tool): tools of each mandate that the registry has approved; tools inside the gateway need no entry."""
    internal = [t for t, spec in P.TOOLS.items() if spec.get("internal")]
    listed = tasks.select("id", F.explode("tools").alias("tool"))
    approved = registry.where(F.col("status") == "approved").select(F.col("name").alias("tool"))
    return listed.join(approved, "tool", "left_semi").unionByName(listed.where(F.col("tool").isin(internal))).distinct()


# ---------------------------------------------------------------- approvals


def decide_approvals(requests: DataFrame, verdicts: DataFrame) -> DataFrame:
    """First verdict per request counts; later ones conflict. Verdicts: request_id, seq, verdict, ts."""
    first = verdicts.groupBy("request_id").agg(
        F.min(F.struct("seq", "verdict", "ts")).alias("_first"), (F.count(F.lit(1)) - 1).alias("conflicts")
    )
    status = F.when(F.col("_first.verdict") == "approve", "approved").when(F.col("_first.verdict") == "deny", "denied")
    joined = requests.join(first.withColumnRenamed("request_id", "id"), "id", "left")
    return joined.select(
        *requests.columns, F.coalesce(status, F.lit("pending")).alias("status"), F.col("_first.ts").alias("decided_at"),
        F.coalesce("conflicts", F.lit(0)).alias("conflicts"),
    )


def match_approvals(calls: DataFrame, approvals: DataFrame, keys: list[str], ttl_seconds: int) -> DataFrame:
    """Each call takes the newest unused approval of the same exact call, if that is still fresh.

    Calls: id, ts, keys. Approvals: id, created_at, decided_at, status, keys. Newest-first use is a stack, so with
    +1 per approval and -1 per call a running sum gives the stack height, and a call meets the latest
    approval at its own height. An expired approval below a call is useless to all later calls too, hence the
    pairing can ignore age and the age test comes last. ``pending`` tells whether an undecided request of the
    same call was open; without one a new request is opened.
    """
    key_cols = [F.col(k) for k in keys]
    up = approvals.where(F.col("status") == "approved").select(
        *key_cols, F.col("decided_at").alias("ts"), F.lit(0).alias("kind"), F.col("id").cast("string").alias("ref"),
        F.lit(1).alias("step"), F.lit(0).alias("open"),
    )
    asked = approvals.select(
        *key_cols, F.col("created_at").alias("ts"), F.lit(1).alias("kind"), F.col("id").cast("string").alias("ref"),
        F.lit(0).alias("step"), F.lit(1).alias("open"),
    )
    closed = approvals.where(F.col("decided_at").isNotNull()).select(
        *key_cols, F.col("decided_at").alias("ts"), F.lit(2).alias("kind"), F.col("id").cast("string").alias("ref"),
        F.lit(0).alias("step"), F.lit(-1).alias("open"),
    )
    used = calls.select(
        *key_cols, "ts", F.lit(3).alias("kind"), F.col("id").cast("string").alias("ref"), F.lit(-1).alias("step"), F.lit(0).alias("open")
    )
    log = reduce(DataFrame.unionByName, [up, asked, closed, used])
    order = ["ts", "kind", "ref"]
    heights = running(
        log, keys, order, {"height": ("sum", F.col("step")), "n_open": ("sum", F.col("open"))}
    ).where(F.col("kind").isin(0, 3))
    # height above an approval, height below a call: equal exactly for partners
    level = F.when(F.col("kind") == 0, F.col("height")).otherwise(F.col("height") + 1)
    moment = F.struct("ts", "kind", "ref")
    met = running(
        heights.withColumn("level", level), [*keys, "level"], order, {"last": ("max", moment)}, inclusive=False,
    ).where(F.col("kind") == 3)
    fresh = (F.col("last.kind") == 0) & (
        F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.col("last.ts").cast("timestamp")) < ttl_seconds * 1_000_000
    )
    return met.select(
        *keys, "ts", F.col("ref").alias("call_id"), F.when(fresh, F.col("last.ref")).alias("approval_id"),
        (F.col("n_open") > 0).alias("pending"),
        F.when(fresh, "APPROVAL-OK").otherwise("APPROVAL-001").alias("rule_id"),
    )


def request_approvals(calls: DataFrame, verdicts: DataFrame, keys: list[str], ttl_seconds: int) -> DataFrame:
    """Calls that need consent, when the requests are opened by the refused calls themselves.

    Calls: id, ts, keys. Verdicts: request_id, seq, verdict (approve or deny), ts; a request has the id of the call that opened it, the
    first verdict counts, and one on a call that opened nothing means nothing. A call uses a fresh approval of the same exact call, once;
    otherwise it is refused and, unless a request is pending, opens one.

    While a request is pending no approval can be fresh, so a key has at most one of either. The call that opens the next request
    after ``c`` therefore follows from ``c`` alone: the first call after the verdict, or the one after it if that one uses the
    approval. This successor is one running minimum from the end for all calls; the calls that really open requests are those that
    the first call of each key reaches through successors, found by pointer doubling in O(log n) rounds.

    Adds ``request_id`` (the request that was used, is pending or was opened), ``opened`` and ``rule_id``.
    """
    given = verdicts.withColumnRenamed("request_id", "id").join(calls.select("id"), "id", "left_semi")
    first = given.groupBy("id").agg(F.min(F.struct("seq", "verdict", "ts")).alias("_v"))
    own = calls.select("id", "ts", *keys).join(first, "id", "left")
    base = cut_lineage(own.select("id", "ts", *keys, F.col("_v.verdict").alias("_verdict"), F.greatest("ts", F.col("_v.ts")).alias("_at")))
    # every call, and every call's verdict, looks for the two calls that follow
    asked = base.where(F.col("_verdict").isNotNull()).select(*keys, F.col("_at").alias("ts"), F.lit(0).alias("_kind"), "id", (F.col("_at") > F.col("ts")).alias("_later"))
    listed = base.select(*keys, "ts", F.lit(1).alias("_kind"), "id", F.lit(False).alias("_later"))
    after = running(listed, keys, ["ts", "id"], {"_then": ("min", F.struct("ts", "id"))}, inclusive=False, reverse=True).select(
        *keys, "ts", "_kind", "id", "_later", F.struct("ts", "id", F.col("_then.id").alias("then")).alias("_here"))
    both = after.unionByName(asked.withColumn("_here", F.lit(None).cast(after.schema["_here"].dataType)))
    # a verdict comes before the calls of its time, and after its own call
    placed = both.withColumns({"_tie": F.when((F.col("_kind") == 0) & F.col("_later"), 0).otherwise(1), "_rank": F.when(F.col("_kind") == 0, 1).otherwise(0)})
    met = running(placed, keys, ["ts", "_tie", "id", "_rank"], {"_next": ("min", F.col("_here"))}, inclusive=False, reverse=True).where(
        F.col("_kind") == 0).select("id", "_next")
    waited = F.unix_micros(F.col("_next.ts").cast("timestamp")) - F.unix_micros(F.col("_at").cast("timestamp"))
    used = (F.col("_verdict") == "approve") & (waited < ttl_seconds * 1_000_000)
    steps = cut_lineage(base.join(met, "id", "left").select(
        "id", "ts", *keys, "_at", F.when(used, F.col("_next.id")).alias("_user"), F.when(used, F.col("_next.then")).otherwise(F.col("_next.id")).alias("_to")))
    heads = steps.groupBy(*keys).agg(F.min(F.struct("ts", "id")).alias("_h")).select(F.col("_h.id").alias("id"))
    reached, jump = cut_lineage(heads), steps.where(F.col("_to").isNotNull()).select("id", "_to")
    while True:
        onward = jump.join(reached, "id").select(F.col("_to").alias("id"))
        grown = cut_lineage(reached.union(onward).distinct())
        if grown.count() == reached.count():
            break
        far = jump.select(F.col("id").alias("_to"), F.col("_to").alias("_far"))
        reached, jump = grown, cut_lineage(jump.join(far, "_to").select("id", F.col("_far").alias("_to")))
    openers = steps.join(reached, "id").withColumn("_open", F.struct("ts", "id", F.col("_user").alias("user")))
    marked = steps.select("id", "ts", *keys).join(openers.select("id", "_open"), "id", "left")
    held = running(marked, keys, ["ts", "id"], {"_last": ("max", F.col("_open"))})
    opened, approved = F.col("_open").isNotNull(), F.coalesce(F.col("_last.user") == F.col("id"), F.lit(False))
    return held.select("id", "ts", *keys, F.col("_last.id").alias("request_id"), opened.alias("opened"),
                       F.when(approved, "APPROVAL-OK").otherwise("APPROVAL-001").alias("rule_id"))


# ---------------------------------------------------------------- memory


def latest_memory(reads: DataFrame, entries: DataFrame) -> DataFrame:
    """What each read of (case_id, key) returns: the newest entry of that case written before it.

    Reads: id, ts, case_id, key. Without such an entry, an entry of another case makes it MEMORY_CROSS_CASE,
    otherwise MEMORY_NOT_FOUND. Both lookups are running maxima, so a popular key is spread over its chunks.
    """
    written = entries.select("case_id", "key", "ts", F.lit(0).alias("kind"), "id", "content", "classification")
    asked = reads.select("case_id", "key", "ts", F.lit(1).alias("kind"), "id", F.lit(None).cast("string").alias("content"),
                         F.lit(None).cast("int").alias("classification"))
    both = written.unionByName(asked)
    order = ["ts", "kind", "id"]
    entry = F.when(F.col("kind") == 0, F.struct("id", "content", "classification"))
    in_case = running(both, ["case_id", "key"], order, {"entry": ("max", entry)})
    any_case = running(in_case, ["key"], order, {"seen": ("count", F.when(F.col("kind") == 0, 1).otherwise(0))})
    reason = F.when(F.col("entry").isNotNull(), "OK").when(F.col("seen") > 0, "MEMORY_CROSS_CASE").otherwise("MEMORY_NOT_FOUND")
    return any_case.where(F.col("kind") == 1).select(
        "id", "ts", "case_id", "key", F.col("entry.content").alias("content"), F.col("entry.classification").alias("label"),
        reason.alias("reason"),
    )

