"""Checks on conversations: message by message, across messages, and on answers and call arguments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callwarden.functions import spans as S
from callwarden.operators import content as C
from callwarden.operators.decide import collect_findings, decide, finding, is_blocked
from callwarden.operators.running import running
from callwarden.rules.patterns import java
from callwarden.session import cut_lineage

TURNS_PER_BLOCK = 1024
CONTEXT_CHARS = 4096
#: Parts of MARKDOWN_EXFIL, which has no length limit: an address, and what leads to it. Turns are joined by blanks, which only the text in
#: square brackets and the gap before the address may hold; every part lies in one turn.
_ADDRESS = r"https?://[^)\s]*[?&][^)\s]*\)"
_OPENS, _CLOSES, _NAMED, _ENDS = r"!\[[^\]]*\Z", r"\A[^\]]*\]\(\s*" + _ADDRESS, r"!\[[^\]]*\]\(\s*\Z", r"\A[^\]]*\]\(\s*\Z"
WITHHELD = "[WITHHELD: content flagged as suspicious by the semantic guard]"


def message_target(role: Column) -> Column:
    return F.when(role == "tool", "tool_results").otherwise("user_input")


def check_messages(messages: DataFrame, controls: C.Controls = C.BALANCED, feed: list[dict] | None = None) -> DataFrame:
    """Findings and clean text of every message (conv_id, turn, role, text); the assistant's own turns are skipped."""
    checked = S.stage(messages.where(~F.col("role").eqNullSafe("assistant")), target=message_target(F.col("role")))
    target = F.col("target")
    scanned = C.scan(checked, "text", target, feed=feed, entities=controls.entities, parts=("signatures", "secrets", "pii", "injection"))
    work = S.stage(scanned, checked.columns, findings=C.content_findings(controls, target))
    work = S.stage(work, decision=decide(F.col("findings")))
    clean = F.when(F.col("decision.action") == "REDACT", S.redact(F.col("text"), C.all_spans(F.col("findings")))).otherwise(F.col("text"))
    return S.stage(work, sanitized=clean).drop("target")


def sanitize_conversations(messages: DataFrame, controls: C.Controls = C.BALANCED) -> DataFrame:
    """Only the messages the guard rewrote."""
    out = check_messages(messages, controls)
    return out.where(F.col("sanitized") != F.col("text")).select("conv_id", "turn", "role", "decision", "sanitized")


def _split_links(turns: DataFrame) -> DataFrame:
    """``conv_id, messages`` where MARKDOWN_EXFIL matches over several of the turns (conv_id, messages, turn, sanitized), however far apart.

    Before each turn it is known whether an image text is open, from the last turn with a bracket of it, and whether an address is
    due, from the last turn that is not blank.
    """
    t = F.coalesce("sanitized", F.lit(""))

    def has(pattern: str) -> Column:
        return t.rlike(java(pattern))

    parts = turns.select("conv_id", "messages", "turn", has(r"!\[|\]").alias("_bracket"), has(r"\S").alias("_said"), has(_OPENS).alias("_opens"),
                         has(_CLOSES).alias("_closes"), has(_NAMED).alias("_named"), has(_ENDS).alias("_ends"), has(r"\A\s*" + _ADDRESS).alias("_address"))
    last = F.when(F.col("_bracket"), F.struct("turn", F.col("_opens").alias("is")))
    work = running(parts, ["conv_id"], ["turn"], {"_open": ("max", last)}, inclusive=False)
    opened = F.coalesce(F.col("_open")["is"], F.lit(False))
    last = F.when(F.col("_said"), F.struct("turn", (F.col("_named") | (opened & F.col("_ends"))).alias("is")))
    work = running(work, ["conv_id"], ["turn"], {"_due": ("max", last)}, inclusive=False)
    hit = (opened & F.col("_closes")) | (F.coalesce(F.col("_due")["is"], F.lit(False)) & F.col("_address"))
    return work.where(hit).select("conv_id", "messages").distinct()


def split_injection(checked: DataFrame) -> DataFrame:
    """Instructions that appear only when the untrusted turns of one conversation are read together.

    Input: ``check_messages``. Conversations with a blocked message, an injection already found, or a single
    untrusted turn are left out by one aggregation. The rest is joined in blocks of consecutive turns; a block also
    sees the end of the block before it, so a conversation of any length is spread over its blocks. Patterns of a few hundred
    characters fit that context; links, which have no length limit, are found by their parts (``_split_links``).
    """
    untrusted = F.col("role").isin("user", "tool")
    stop = is_blocked(F.col("findings")) | F.exists("findings", lambda f: f["rule_id"] == "INJ-001")
    # read twice below: stored once, so that the messages are not scanned twice
    checked = cut_lineage(checked.select("conv_id", "turn", "role", "sanitized", stop.alias("_stop")))
    flags = checked.groupBy("conv_id").agg(F.count_if(untrusted).alias("messages"), F.bool_or("_stop").alias("_skip"))
    eligible = flags.where(~F.col("_skip") & (F.col("messages") > 1)).select("conv_id", "messages")
    turns = checked.where(untrusted).select("conv_id", "turn", "sanitized").join(eligible, "conv_id")
    numbered = running(turns, ["conv_id"], ["turn"], {"_n": ("count", F.lit(1))})
    block = F.floor((F.col("_n") - 1) / TURNS_PER_BLOCK)
    blocks = numbered.groupBy("conv_id", "messages", block.alias("block")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "sanitized"))), lambda t: t["sanitized"]), " ").alias("joined")
    )
    tails = blocks.select("conv_id", (F.col("block") + 1).alias("block"), F.substring("joined", -CONTEXT_CHARS, CONTEXT_CHARS).alias("_before"))
    texts = blocks.join(tails, ["conv_id", "block"], "left").select("conv_id", "messages", F.concat_ws(" ", "_before", "joined").alias("joined"))
    found = C.scan(texts, "joined", "user_input", parts=("injection",)).where(F.size("injection_spans") > 0)
    labels = found.select("conv_id", "messages", F.explode(S.span_labels(F.col("injection_spans"))).alias("label"))
    labels = labels.unionByName(_split_links(turns).withColumn("label", F.lit("MARKDOWN_EXFIL")))
    return labels.groupBy("conv_id", "messages").agg(F.array_sort(F.collect_set("label")).alias("patterns")).select(
        "conv_id", "messages", "patterns", F.lit("INJ-002").alias("rule_id"), F.lit("BLOCK").alias("action")
    )


def filter_output(df: DataFrame, target: Column | str, text: str = "text", controls: C.Controls = C.BALANCED,
                  active_kinds: Column | None = None) -> DataFrame:
    """What is released of an answer or a tool result: the text, a redacted text, a notice, or nothing.

    Answers (``model_output``) get no injection rule and no risk score; tool results get both, but no personal-data
    rule. ``active_kinds`` are active parts of a file that was read.
    """
    target = F.lit(target) if isinstance(target, str) else target
    results = target == "tool_results"
    scanned = C.scan(df, text, target, pii_when=~results, inbound=results)
    findings = [C.content_findings(controls, target, ~results)]
    if active_kinds is not None:
        made = finding(C._action(controls.documents_mode), "DOC-001", "ACTIVE_CONTENT_IN_DOCUMENT", "signatures",
                       {"kinds": F.array_join(F.array_sort(active_kinds), ","), "target": target})
        findings.insert(0, collect_findings(F.when(C._col(controls.documents_on) & (F.size(active_kinds) > 0), made)))
    work = S.stage(scanned, _before=F.concat(*findings))
    scored = F.when(
        C._col(controls.semantic_on) & results & ~is_blocked(F.col("_before")) & F.col(text).rlike(r"(?U)\S"),
        C.risk_finding(controls, F.col("risk"), F.col("risk_features")),
    )
    work = S.stage(work, df.columns, findings=F.concat(F.col("_before"), collect_findings(scored)))
    work = S.stage(work, decision=decide(F.col("findings")), _cut=C.all_spans(F.col("findings")))
    released = (
        F.when(F.col("decision.action") == "BLOCK", F.lit(None).cast("string"))
        .when((F.col("decision.action") == "REDACT") & results & (F.size("_cut") == 0), WITHHELD)
        .when(F.col("decision.action") == "REDACT", S.redact(F.col(text), F.col("_cut")))
        .otherwise(F.col(text))
    )
    return S.stage(work, released=released).drop("_cut")


def redact_call_args(args: DataFrame, clearance: Column, writes: Column, controls: C.Controls = C.BALANCED) -> DataFrame:
    """Each content argument (one row: id, tool, name, value) redacted on its own: credentials, signatures, and
    personal data when it leaves for a sink below CONFIDENTIAL."""
    pii = writes & (clearance < 2) & C._col(controls.pii_on)
    scanned = C.scan(args, "value", "tool_args", tool=F.col("tool"), entities=controls.entities, pii_when=pii,
                     parts=("signatures", "secrets", "pii"))
    secrets = F.when(C._col(controls.secrets_on), F.col("secret_spans")).otherwise(S.empty_spans())
    spans = F.concat(secrets, F.col("pii_spans"), F.flatten(F.transform("sig_hits", lambda h: h["spans"])))
    return scanned.select(*args.columns, S.redact(F.col("value"), spans).alias("redacted"))


def score_distinct(df: DataFrame, text: str = "text") -> DataFrame:
    """Risk of every row, with each distinct text scored once.

    Texts meet by hash with map-side combination. The scored side has one row per text, and adaptive execution
    splits the rows of a text that is copied very often.
    """
    keyed = df.withColumn("_h", F.sha2(F.col(text), 256))
    distinct = keyed.groupBy("_h").agg(F.min(text).alias("_t"))
    scored = C.scan(distinct, "_t", "user_input", parts=("injection", "risk")).select("_h", "risk", "risk_features")
    return keyed.join(scored, "_h", "left").drop("_h")


def try_signature(df: DataFrame, pattern: str, flags: str = "", text: str = "text", limit: int | None = None, cut: int | None = None) -> DataFrame:
    """Try a candidate pattern: texts with their matches; a short report asks for ``limit`` matches of ``cut`` characters at most."""
    rx = java(pattern, "i" if "i" in flags else "")
    found = F.regexp_extract_all(F.col(text), F.lit(rx), F.lit(0))
    if limit is not None:
        found = F.slice(found, 1, limit)
    if cut is not None:
        found = F.transform(found, lambda m: F.substring(m, 1, cut))
    return df.where(F.col(text).rlike(rx)).withColumn("matches", found)

