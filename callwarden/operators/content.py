"""Content checks: scan texts once, then judge the scan under any set of controls."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callwarden.functions import normalize as N
from callwarden.functions import spans as S
from callwarden.functions.hints import Hints
from callwarden.operators import detect as D
from callwarden.operators.decide import collect_findings, decide, finding, is_blocked
from callwarden.rules import patterns as P
from callwarden.rules import policy as policy_values
from callwarden.rules.feed import SIGNATURES

SCAN_COLUMNS = ["sig_hits", "secret_spans", "pii_spans", "injection_names", "injection_spans", "risk", "risk_features"]


def _col(value: Any) -> Column:
    return value if isinstance(value, Column) else F.lit(value)


PARTS = ("signatures", "secrets", "pii", "injection", "risk")


@dataclass(frozen=True)
class Controls:
    """Switches of one policy; every value is a constant or a Column (one policy per row)."""

    signatures_on: Any = True
    signatures_mode: Any = "block"
    secrets_on: Any = True
    secrets_mode: Any = "block"
    pii_on: Any = True
    pii_mode: Any = "redact"
    injection_on: Any = True
    injection_mode: Any = "redact"
    semantic_on: Any = True
    block_at: Any = 0.7
    redact_at: Any = 0.5
    on_error: Any = "block"
    ifc_on: Any = True
    mandate_on: Any = True
    model_allowlist_on: Any = True
    code_on: Any = True
    code_mode: Any = "sandbox"
    documents_on: Any = True
    documents_mode: Any = "block"
    entities: list[str] = field(default_factory=lambda: list(D.ALL_ENTITIES))

    # (control, field) of the long policy form behind each attribute
    FIELDS = {
        "signatures_on": ("attack_signatures", "enabled"),
        "signatures_mode": ("attack_signatures", "mode"),
        "secrets_on": ("secrets", "enabled"),
        "secrets_mode": ("secrets", "mode"),
        "pii_on": ("pii", "enabled"),
        "pii_mode": ("pii", "mode"),
        "injection_on": ("injection_heuristics", "enabled"),
        "injection_mode": ("injection_heuristics", "mode"),
        "semantic_on": ("semantic", "enabled"),
        "block_at": ("semantic", "block_at_risk"),
        "redact_at": ("semantic", "redact_at_risk"),
        "on_error": ("semantic", "on_error"),
        "ifc_on": ("ifc_taint", "enabled"),
        "mandate_on": ("mandate", "enabled"),
        "model_allowlist_on": ("model_allowlist", "enabled"),
        "code_on": ("code_execution", "enabled"),
        "code_mode": ("code_execution", "mode"),
        "documents_on": ("documents", "enabled"),
        "documents_mode": ("documents", "mode"),
    }

    @classmethod
    def preset(cls, profile: str) -> Controls:
        """A built-in profile under the default explicit settings."""
        values = {(c, f): v for c, f, v in policy_values.CONTROL_DEFAULTS}
        values |= {(c, f): v for p, c, f, v in policy_values.PROFILES if p == profile}
        values |= {(c, f): v for c, f, v in policy_values.EXPLICIT}
        typed = {}
        for attr, key in cls.FIELDS.items():
            raw = values[key]
            typed[attr] = raw == "true" if key[1] == "enabled" else float(raw) if "risk" in key[1] else raw
        return cls(**typed)

    @classmethod
    def from_struct(cls, controls: str) -> Controls:
        """Controls read from a struct column whose fields carry the attribute names."""
        return cls(**{attr: F.col(f"{controls}.{attr}") for attr in cls.FIELDS})

    def but(self, **changes: Any) -> Controls:
        return replace(self, **changes)


# dataclass fields only: FIELDS above is a plain class attribute
BALANCED = Controls.preset("balanced")


VARIANTS = ("_v1", "_v2", "_v3", "_v4")


def _with_variants(work: DataFrame, t: Column, injection: list, hints: Hints, no_names: str) -> DataFrame:
    """Injection names found in the rewritten texts (v1 cleaned, v2 joined, v3 unleeted) and in base64 payloads (v4).

    A text is rewritten only if it can differ and a pattern may match what comes out.
    """
    nothing = F.array().cast(D.STRINGS)
    look = F.col("_look")
    clean = F.coalesce(look["clean"], t)
    work = S.stage(work, _joined=F.when(look["spaced"], N.join_spaced(clean)))
    work = S.stage(work, _leet=F.when(F.size(look["leet_may"]) > 0, N.unleet(F.coalesce("_joined", clean))))
    payloads = F.col("_in") & F.expr(hints.test("_look.may")(P.BASE64_RUN))
    work = S.stage(
        work,
        _t1=look["clean"],
        _t2=F.when(~F.col("_joined").isin(clean, t), F.col("_joined")),
        _t3=F.when(~F.col("_leet").isin(F.coalesce("_joined", clean), t), F.col("_leet")),
        _payloads=F.when(payloads, N.base64_payloads(t)).otherwise(nothing),
    )
    names = {
        v: F.expr(f"CASE WHEN {t_} IS NOT NULL THEN {D.matched_names(t_, injection, may)} ELSE {no_names} END")
        for t_, v, may in (("_t1", "_v1", hints.test("_look.clean_may")), ("_t2", "_v2", None), ("_t3", "_v3", hints.test("_look.leet_may")))
    }
    payload = F.expr(f"CASE WHEN size(_payloads) > 0 THEN {D.payload_names('_payloads')} ELSE {no_names} END")
    return S.stage(work, **names, _v4=payload)


def scan(
    df: DataFrame,
    text: str = "text",
    target: Column | str = "user_input",
    tool: Column | None = None,
    feed: list[dict] | None = None,
    entities: list[str] | None = None,
    pii_when: Column | None = None,
    inbound: Column | None = None,
    parts: tuple[str, ...] = PARTS,
) -> DataFrame:
    """Add the raw detector results of every text (``SCAN_COLUMNS``); parts left out stay empty and cost nothing.

    Narrow: one pass per row, no shuffle. One Arrow pass names the patterns that may match (:mod:`hints`). The stages are separate projections because each result feeds
    several later ones; Catalyst keeps such projections apart, so nothing is evaluated twice.
    """
    shared = target if isinstance(target, str) else None
    target = _col(target)
    tool = F.lit(None).cast("string") if tool is None else tool
    inbound = target.isin(D.INBOUND) if inbound is None else inbound
    if "injection" not in parts and "risk" not in parts:
        inbound = F.lit(False)
    kept = df.columns
    t = F.col("_text")
    nothing = F.array().cast(D.STRINGS)
    injection = D.injection_rules()

    work = S.stage(df, _text=F.coalesce(F.col(text), F.lit("")), _target=target, _tool=tool, _in=F.coalesce(inbound, F.lit(False)))
    no_rules = f"cast(array() AS {S.MATCHED_TYPE})"
    no_names = f"cast(array() AS {D.STRINGS})"
    known = (SIGNATURES if feed is None else feed) if "signatures" in parts else []
    signatures = D.inline_signatures(known, "_target", "_tool", shared)
    pii = D.pii_rules(entities) if "pii" in parts else []
    secrets = D.secret_rules() if "secrets" in parts else []
    risks = D.risk_rules() if "risk" in parts else []
    rules = [*pii, *secrets, *risks, *(signatures or [])]
    inside = "injection" in parts
    hints = Hints([*[r.pattern for r in rules], *([P.BASE64_RUN] if inside else [])], [r.pattern for r in injection] if inside else [])
    work = S.stage(work, _look=hints.function()(t, F.col("_in")))
    may = hints.test("_look.may")
    base = [*kept, "_text", "_in", "_look"]
    if inside:
        work = _with_variants(work, t, injection, hints, no_names)
        plain_rules = F.expr(f"CASE WHEN _in THEN {S.matched('_text', injection, may)} ELSE {no_rules} END")
    else:
        work = S.stage(work, **{v: nothing for v in VARIANTS})
        plain_rules = F.expr(no_rules)
    if signatures is None:
        sig = D.picked_signatures("_text", S.fold_case(t), "_target", "_tool", known, shared)
    else:
        sig = F.expr(S.matched("_text", signatures, may))
    work = S.stage(
        work, [*base, *VARIANTS],
        _inj=plain_rules,
        _pii=F.expr(S.matched("_text", pii, may, sure=False)),
        _sec=F.expr(S.matched("_text", secrets, may, sure=False)),
        _sig=sig,
    )
    work = S.stage(work, _plain=F.transform(F.col("_inj"), lambda r: r["name"]))
    rewritten = F.array_except(F.concat("_v1", "_v2", "_v3"), F.col("_plain"))
    hidden_names = F.array_sort(
        F.transform(F.array_union(rewritten, F.col("_v4")), lambda n: F.concat(F.lit("OBFUSCATED_"), n))
    )
    work = S.stage(work, _obf=hidden_names, _hidden=F.when(F.size("_plain") > 0, S.extract(t, F.expr(S.matched("_text", D.hidden_rules())))))
    whole = F.array(S.span(F.lit(0), F.length(t), F.element_at(F.col("_obf"), 1)))
    pii_rules = F.col("_pii") if pii_when is None else F.when(pii_when, F.col("_pii")).otherwise(F.expr(no_rules))
    injected = F.when(F.size("_plain") > 0, D.injection_spans(t, F.col("_inj"), F.col("_hidden"))).when(F.size("_obf") > 0, whole)
    work = S.stage(
        work, base,
        sig_hits=D.signature_hits(t, F.col("_sig")),
        secret_spans=D.secret_spans(t, F.col("_sec")),
        pii_spans=D.pii_spans(t, pii_rules),
        injection_names=F.array_sort(F.array_union(F.col("_plain"), F.col("_obf"))),
        injection_spans=injected.otherwise(S.empty_spans()),
    )
    features = D.risk_features("_text", may, F.size("injection_spans") > 0) if "risk" in parts else nothing
    work = S.stage(work, [*kept, *SCAN_COLUMNS[:5]], risk_features=F.when(F.col("_in"), features).otherwise(nothing))
    return S.stage(work, risk=D.risk_score(F.col("risk_features"))).select(*kept, *SCAN_COLUMNS)


def _action(mode: Any) -> Column:
    return F.when(_col(mode) == "block", "BLOCK").otherwise("REDACT")


def content_findings(controls: Controls, target: Column | str, pii_applies: Column | bool = True,
                     injection: Column | bool = True) -> Column:
    """Findings of a scanned row, in order: signatures, credentials, personal data, injection."""
    target = _col(target)
    signatures = F.transform(
        F.col("sig_hits"),
        lambda h: finding(
            _action(controls.signatures_mode), h["id"], "KNOWN_ATTACK_SIGNATURE", "signatures",
            {"target": target, "matches": F.size(h["spans"])},
            h["spans"],
        ),
    )

    def spans_finding(on, mode, rule, reason, column, key, names):
        spans = F.col(column)
        made = finding(_action(mode), rule, reason, "deterministic",
                       {key: F.array_join(names, ","), "count": F.size(spans)}, spans)
        return F.when(_col(on) & (F.size(spans) > 0), made)

    rest = collect_findings(
        spans_finding(controls.secrets_on, controls.secrets_mode, "SEC-001", "SECRET_DETECTED", "secret_spans", "types",
                      S.span_labels(F.col("secret_spans"))),
        spans_finding(_col(controls.pii_on) & _col(pii_applies), controls.pii_mode, "PII-001", "PII_DETECTED",
                      "pii_spans", "entities", S.span_labels(F.col("pii_spans"))),
        spans_finding(_col(controls.injection_on) & target.isin(D.INBOUND) & _col(injection), controls.injection_mode,
                      "INJ-001", "PROMPT_INJECTION_HEURISTIC", "injection_spans", "patterns", F.col("injection_names")),
    )
    none = F.filter(signatures, lambda f: F.lit(False))
    return F.concat(F.when(_col(controls.signatures_on), signatures).otherwise(none), rest)


def risk_finding(controls: Controls, risk: Column, features: Column, error: Column | None = None) -> Column:
    """The scorer may only tighten: BLOCK or REDACT above the thresholds, otherwise a note."""
    detail = {"risk": risk, "label": D.risk_label(features), "reason": D.risk_reason(features), "backend": "heuristic"}
    block = finding("BLOCK", "SEM-001", "SEMANTIC_MANIPULATION", "semantic", detail | {"threshold": _col(controls.block_at)})
    cut = finding("REDACT", "SEM-002", "SEMANTIC_SUSPICIOUS", "semantic", detail | {"threshold": _col(controls.redact_at)})
    fine = finding("ALLOW", "SEM-000", "SEMANTIC_OK", "semantic", {"risk": risk, "backend": "heuristic"})
    scored = F.when(risk >= _col(controls.block_at), block).when(risk >= _col(controls.redact_at), cut).otherwise(fine)
    if error is None:
        return scored
    failed = finding("BLOCK", "SEM-ERR", "SEMANTIC_GUARD_UNAVAILABLE", "semantic", detail | {"error": error})
    return F.when(error.isNull(), scored).when(_col(controls.on_error) == "allow", fine).otherwise(failed)


def flow_finding(controls: Controls, level: Column, sink: Column, clearance: Column) -> Column:
    made = finding("BLOCK", "IFC-001", "DATA_FLOW_VIOLATION", "data_flow",
                   {"task_classification": level_name(level), "sink": sink, "sink_clearance": level_name(clearance)})
    return F.when(_col(controls.ifc_on) & (level > clearance), made)


def level_name(level: Column) -> Column:
    return F.element_at(F.array(*[F.lit(n) for n in policy_values.LEVELS]), level.cast("int") + 1)


def level_of(name: Column) -> Column:
    """Level of a classification name; null for an unknown name."""
    pairs = [x for n, v in policy_values.LEVELS.items() for x in (F.lit(n), F.lit(v))]
    return F.try_element_at(F.create_map(*pairs), F.upper(name))


def sink_level(sink: Column, sinks: dict[str, str] | None = None) -> Column:
    """Clearance of a sink; an unknown sink is PUBLIC, the strictest."""
    known = policy_values.SINKS if sinks is None else sinks
    pairs = [x for n, v in known.items() for x in (F.lit(n), F.lit(policy_values.LEVELS[v]))]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), sink), F.lit(policy_values.PUBLIC))


def judge(
    scanned: DataFrame,
    controls: Controls = BALANCED,
    text: str = "text",
    target: Column | str = "user_input",
    sink: Column | None = None,
    level: Column | None = None,
    extra: Column | None = None,
) -> DataFrame:
    """Dry-run decision of every scanned row: findings, decision and redacted text."""
    target = _col(target)
    pii_applies: Column | bool = True
    parts = [] if extra is None else [extra]
    if sink is not None:
        clearance = sink_level(sink)
        pii_applies = sink.isNull() | (clearance < policy_values.CONFIDENTIAL) | (target != "tool_args")
    parts.append(content_findings(controls, target, pii_applies))
    if sink is not None:
        flow = flow_finding(controls, F.coalesce(level, F.lit(0)), sink, clearance)
        parts.append(collect_findings(F.when(sink.isNotNull(), flow)))
    work = S.stage(scanned, _before=F.concat(*parts))
    scored = F.when(
        _col(controls.semantic_on) & target.isin(D.INBOUND) & ~is_blocked(F.col("_before"))
        & F.col(text).rlike(r"(?U)\S"),
        risk_finding(controls, F.col("risk"), F.col("risk_features")),
    )
    kept = [c for c in scanned.columns if c not in SCAN_COLUMNS]
    work = S.stage(work, kept, findings=F.concat(F.col("_before"), collect_findings(scored)))
    work = S.stage(work, decision=decide(F.col("findings")))
    cut = F.when(F.col("decision.action") == "REDACT", S.redact(F.col(text), all_spans(F.col("findings"))))
    return S.stage(work, redacted=cut)


def all_spans(findings: Column) -> Column:
    return F.flatten(F.transform(findings, lambda f: f["spans"]))


def evaluate(df: DataFrame, controls: Controls = BALANCED, text: str = "text", target: Column | str = "user_input",
             sink: Column | None = None, level: Column | None = None, tool: Column | None = None,
             feed: list[dict] | None = None, extra: Column | None = None) -> DataFrame:
    """Scan and judge in one go: what would be decided about these texts, with nothing executed."""
    scanned = scan(df, text, target, tool, feed, controls.entities)
    return judge(scanned, controls, text, target, sink, level, extra)
