"""One decision per tool call: guard, mandate, content, information flow, approval and budget, in this order.

Everything that only looks at the call itself is one narrow projection. The level that a task carries comes from the
reads that were really let through, its own and those of tasks below it; it joins by task as one row each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callwarden.functions import spans as S
from callwarden.operators import access as A
from callwarden.operators import content as C
from callwarden.operators import flow
from callwarden.operators.decide import collect_findings, decide, finding, is_blocked
from callwarden.rules import policy as P
from callwarden.session import cut_lineage


def _spec(field: str) -> dict:
    return {tool: spec[field] for tool, spec in P.TOOLS.items() if spec.get(field)}


def _arg(name: Column) -> Column:
    return F.coalesce(F.try_element_at("args", name), F.lit(""))


def writes(tool: Column) -> Column:
    """Known tools write unless they are declared not to."""
    return tool.isin([t for t, spec in P.TOOLS.items() if spec.get("writes", True)])


def outbound_text(tool: Column) -> Column:
    """The content arguments of a call that are there and not empty, one per line."""
    names = A.lookup({t: ",".join(n) for t, n in _spec("content").items()}, tool)
    values = F.transform(F.split(names, ","), _arg)
    return F.coalesce(F.array_join(F.filter(values, lambda v: v != ""), "\n"), F.lit(""))


def guard_finding(breaker: dict | None = None) -> Column:
    """The breaker speaks before the rate limit. Flags that are null refuse nothing."""
    breaker = P.BREAKER if breaker is None else breaker
    opened = finding("BLOCK", "CIRCUIT-001", "CIRCUIT_OPEN", "budget",
                     {"blocked_recently": F.col("recent_blocks"), "threshold": breaker["blocks"], "window_seconds": breaker["window_seconds"]})
    limited = finding("BLOCK", "RATE-001", "RATE_LIMITED", "budget", {"scope": F.col("rate_scope"), "count": F.col("rate_count")})
    return F.when(F.col("breaker_refused"), opened).when(F.col("rate_refused"), limited)


def guard_refuses() -> Column:
    """The guard's flags refuse the call; flags that are null refuse nothing."""
    return F.coalesce(F.col("breaker_refused"), F.lit(False)) | F.coalesce(F.col("rate_refused"), F.lit(False))


def mandate_findings(mandate_on: Column | bool, code_on: Column | bool, code_mode: Column | str) -> Column:
    """All that the mandate, the code rule and the tool registry object to; an unknown tool has no further checks."""
    tool = F.col("tool")
    on = F.lit(mandate_on) if isinstance(mandate_on, bool) else mandate_on
    path = _arg(A.lookup(_spec("resource"), tool))
    to = _arg(A.lookup(_spec("recipient"), tool))
    resource = finding("BLOCK", "MANDATE-RES", "RESOURCE_NOT_IN_MANDATE", "mandate", {"resource": path})
    recipient = finding("BLOCK", "MANDATE-RCPT", "RECIPIENT_NOT_ALLOWED", "mandate",
                        {"recipient": to, "allowed": F.array_join("recipients_allow", ",")})

    def refused(allowed: Column) -> Column:
        return on & ~F.coalesce(allowed, F.lit(False))

    return collect_findings(
        A.tool_finding(tool, F.col("tools"), mandate_on),
        F.when(tool.isin(list(_spec("resource"))) & refused(A.resource_allowed(path, F.col("resource_rx"))), resource),
        F.when(tool.isin(list(_spec("recipient"))) & refused(A.recipient_allowed(to, F.col("recipient_rx"))), recipient),
        A.code_finding(tool, code_on, code_mode),
        A.quarantine_finding(tool, F.col("tool_status")),
    )


def check_calls(calls: DataFrame, breaker: dict | None = None, mandate_on: Column | bool = True, code_on: Column | bool = True,
                code_mode: Column | str = "sandbox") -> DataFrame:
    """Calls with the ``findings`` that need no content: guard, else mandate.

    Calls: id, ts, task_id, tool, args (``map<string,string>``), the mandate (tools, recipients_allow, resource_rx,
    recipient_rx), tool_status of the registry, and the guard's flags (recent_blocks, breaker_refused, rate_scope,
    rate_count, rate_refused). A null mandate allows nothing.
    """
    guard = collect_findings(guard_finding(breaker))
    both = F.when(F.size(guard) > 0, guard).otherwise(mandate_findings(mandate_on, code_on, code_mode))
    return S.stage(calls, findings=both)


def is_open() -> Column:
    """Nothing has refused the checked call yet, so content, flow and approval still have a say. The others keep their ``findings``."""
    return A.tool_known(F.col("tool")) & ~is_blocked(F.col("findings"))


def settle(refused: DataFrame) -> DataFrame:
    """``decision`` of calls that are not open: their findings are complete, and their texts are never looked at."""
    return S.stage(refused, decision=decide(F.col("findings")))


def executed_reads(checked: DataFrame, catalog: DataFrame) -> DataFrame:
    """Labels of the reads that nothing refused: a refused read taints nobody. Case law is public, so only documents count."""
    ran = checked.where((F.col("tool") == "doc.read") & ~is_blocked(F.col("findings")))
    return flow.label_reads(ran.select("id", "ts", "task_id", "tool", F.try_element_at("args", F.lit("path")).alias("path")), catalog)


def authorize(checked: DataFrame, controls: C.Controls = C.BALANCED, feed: list[dict] | None = None,
              approval_tools: list[str] | None = None) -> DataFrame:
    """``findings`` and ``decision`` of each call.

    Input: ``check_calls`` with sink, clearance and level. Content and flow are looked at only if nothing blocked the call
    before; both may object, and calls that are not open can as well be set aside (``settle``). Calls that need a person's consent and are not blocked get APPROVAL-001, unless the row
    carries the id of a fitting approval in ``approval_id`` (``access.match_approvals`` over the calls that need one).
    """
    tool, sink = F.col("tool"), F.col("sink")
    gated = P.APPROVAL_TOOLS if approval_tools is None else approval_tools
    work = S.stage(checked, _open=is_open(), _outbound=F.when(is_open(), outbound_text(tool)).otherwise(""), _before=F.col("findings"))
    outside = writes(tool) & (F.col("clearance") < P.CONFIDENTIAL)
    scanned = C.scan(work, "_outbound", "tool_args", tool=tool, feed=feed, entities=controls.entities, pii_when=outside,
                     parts=("signatures", "secrets", "pii"))
    content = C.content_findings(controls, "tool_args", outside)
    leak = F.when(writes(tool), C.flow_finding(controls, F.col("level"), sink, F.col("clearance")))
    added = F.filter(F.concat(content, collect_findings(leak)), lambda f: F.col("_open"))
    work = S.stage(scanned, [c for c in checked.columns if c != "findings"], _open=F.col("_open"), _found=F.concat("_before", added))
    approval = F.col("approval_id") if "approval_id" in checked.columns else F.lit(None).cast("string")
    consent = F.when(approval.isNotNull(), finding("ALLOW", "APPROVAL-OK", "APPROVED_BY_PERSON", "approval", {"approval_id": approval})).otherwise(
        finding("BLOCK", "APPROVAL-001", "APPROVAL_REQUIRED", "approval", {"tool": tool, "sink": sink}))
    asked = F.when(F.col("_open") & ~is_blocked(F.col("_found")) & (tool.isin(gated) | sink.isin(gated)), consent)
    work = S.stage(work, [c for c in checked.columns if c != "findings"], findings=F.concat("_found", collect_findings(asked)))
    return S.stage(work, decision=decide(F.col("findings")))


def grant_requests(decided: DataFrame, verdicts: DataFrame, keys: list[str], ttl_seconds: int = P.APPROVAL_TTL_SECONDS) -> DataFrame:
    """Decisions after people have answered the requests that refused calls opened (``access.request_approvals``).

    Input: ``authorize`` without approvals, with the columns ``keys`` that make two calls the same. Calls that were not refused for
    want of consent keep their decision; the others get APPROVAL-OK, or APPROVAL-001 with the request they opened or wait for.
    """
    waiting = F.exists("findings", lambda f: f["rule_id"] == "APPROVAL-001")
    decided = cut_lineage(decided)
    asked = A.request_approvals(decided.where(waiting).select("id", "ts", *keys), verdicts, keys, ttl_seconds)
    answers = asked.select("id", F.col("request_id").cast("string").alias("_request"), F.col("rule_id").alias("_rule"), F.col("opened").alias("_opened"))
    request = F.col("_request")
    consent = F.when(F.col("_rule") == "APPROVAL-OK", finding("ALLOW", "APPROVAL-OK", "APPROVED_BY_PERSON", "approval", {"approval_id": request})).when(
        F.col("_rule").isNotNull(), finding("BLOCK", "APPROVAL-001", "APPROVAL_REQUIRED", "approval", {"approval_id": request, "opened": F.col("_opened")}))
    others = F.filter("findings", lambda f: f["rule_id"] != "APPROVAL-001")
    kept = [c for c in decided.columns if c not in ("findings", "decision")]
    work = S.stage(decided.join(answers, "id", "left"), [*kept, "_request"], findings=F.concat(others, collect_findings(consent)))
    return S.stage(work, decision=decide(F.col("findings"))).withColumnRenamed("_request", "request_id")


def refuse_over_budget(decided: DataFrame, admission: DataFrame) -> DataFrame:
    """Decisions after admission (``ledger.admit`` over the calls not blocked: id, admitted, scope, dimension)."""
    refused = admission.where(~F.col("admitted")).select("id", F.col("scope").alias("_scope"), F.col("dimension").alias("_dimension"))
    over = F.when(F.col("_dimension").isNotNull() & ~is_blocked(F.col("findings")),
                  finding("BLOCK", "BUD-002", "BUDGET_EXCEEDED", "budget", {"scope": F.col("_scope"), "dimension": F.col("_dimension")}))
    kept = [c for c in decided.columns if c not in ("findings", "decision")]
    work = S.stage(decided.join(refused, "id", "left"), kept, findings=F.concat("findings", collect_findings(over)))
    return S.stage(work, decision=decide(F.col("findings")))
