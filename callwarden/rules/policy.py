"""Default policy values: sinks, limits, presets and mandate templates.

Fixed values: decisions depend on them. Everything can be replaced by tables of the same shape.
"""

from __future__ import annotations

PUBLIC, INTERNAL, CONFIDENTIAL, SECRET = 0, 1, 2, 3
LEVELS = {"PUBLIC": PUBLIC, "INTERNAL": INTERNAL, "CONFIDENTIAL": CONFIDENTIAL, "SECRET": SECRET}

SINKS = {
    "llm:local": "SECRET",
    "llm:onprem": "CONFIDENTIAL",
    "llm:external": "PUBLIC",
    "notes.write": "CONFIDENTIAL",
    "memory.write": "CONFIDENTIAL",
    "mail.send:internal": "CONFIDENTIAL",
    "mail.send:external": "PUBLIC",
    "http.post": "PUBLIC",
    "legal_db.search": "INTERNAL",
    "code.run": "INTERNAL",
}
INTERNAL_DOMAINS = ["lawfirm.example"]
PROVIDER_SINKS = {"mock": "llm:local"}
MODEL_ALLOW = ["mock/echo", "main/*"]
APPROVAL_TOOLS = ["http.post"]
APPROVAL_TTL_SECONDS = 900

# tool -> which arguments carry content, which argument names a resource or a recipient, and what the tool does
TOOLS = {
    "doc.read": {"content": [], "resource": "path", "reads": True, "writes": False},
    "legal_db.search": {"content": ["query"], "reads": True},
    "notes.write": {"content": ["title", "body"]},
    "mail.send": {"content": ["subject", "body"], "recipient": "to"},
    "http.post": {"content": ["url", "body"]},
    "code.run": {"content": ["code"]},
    "memory.write": {"content": ["key", "content"], "internal": True},
    "memory.read": {"content": [], "reads": True, "writes": False, "internal": True},
}

RATE_LIMITS = {"agent": 60, "principal": 120, "global": 1000}
BREAKER = {"blocks": 10, "window_seconds": 60}
BUDGETS = {
    "default_max_tokens": 1024,
    "per_principal": {"tokens": 200_000, "calls": 2_000, "concurrency": 20},
    "global": {"tokens": 2_000_000, "calls": 20_000, "concurrency": 100},
    "guard": {"tokens": 200_000, "calls": 5_000, "concurrency": 1_000},
    "usd_per_1k_tokens": 0.002,
    "max_delegation_depth": 3,
}

# long form: (control, field, value) that every profile starts from
CONTROL_DEFAULTS = [
    ("mandate", "enabled", "true"),
    ("ifc_taint", "enabled", "true"),
    ("model_allowlist", "enabled", "true"),
    ("pii", "enabled", "true"),
    ("pii", "mode", "redact"),
    ("secrets", "enabled", "true"),
    ("secrets", "mode", "block"),
    ("attack_signatures", "enabled", "true"),
    ("attack_signatures", "mode", "block"),
    ("injection_heuristics", "enabled", "true"),
    ("injection_heuristics", "mode", "redact"),
    ("semantic", "enabled", "true"),
    ("semantic", "block_at_risk", "0.7"),
    ("semantic", "redact_at_risk", "0.5"),
    ("semantic", "on_error", "block"),
    ("code_execution", "enabled", "true"),
    ("code_execution", "mode", "sandbox"),
    ("documents", "enabled", "true"),
    ("documents", "mode", "block"),
]
PROFILES = [
    ("strict", "semantic", "block_at_risk", "0.4"),
    ("strict", "semantic", "redact_at_risk", "0.25"),
    ("strict", "pii", "mode", "block"),
    ("strict", "injection_heuristics", "mode", "block"),
    ("strict", "code_execution", "mode", "block"),
    ("balanced", "semantic", "block_at_risk", "0.7"),
    ("balanced", "semantic", "redact_at_risk", "0.5"),
    ("balanced", "pii", "mode", "redact"),
    ("balanced", "injection_heuristics", "mode", "redact"),
    ("balanced", "code_execution", "mode", "sandbox"),
    ("permissive", "semantic", "block_at_risk", "0.9"),
    ("permissive", "semantic", "redact_at_risk", "0.75"),
    ("permissive", "pii", "mode", "redact"),
    ("permissive", "injection_heuristics", "mode", "redact"),
    ("permissive", "code_execution", "mode", "sandbox"),
]
EXPLICIT = [("secrets", "mode", "block"), ("attack_signatures", "mode", "block"), ("documents", "mode", "block")]

TASK_PROFILES = [
    {
        "profile": "contract_review",
        "resources": ["/clients/{client}/*", "/public/*"],
        "tools": ["doc.read", "legal_db.search", "notes.write", "memory.read", "memory.write", "mail.send"],
        "recipients_allow": ["*@lawfirm.example", "*@client-{client}.example"],
        "models": None, "tokens": 20_000, "calls": 30, "concurrency": 3, "ttl_seconds": 900,
    },
    {
        "profile": "data_task",
        "resources": ["/public/*"],
        "tools": ["doc.read", "legal_db.search", "code.run", "notes.write"],
        "recipients_allow": [],
        "models": None, "tokens": 20_000, "calls": 30, "concurrency": 3, "ttl_seconds": 900,
    },
    {
        "profile": "research",
        "resources": ["/public/*"],
        "tools": ["legal_db.search", "http.post", "notes.write"],
        "recipients_allow": [],
        "models": None, "tokens": 10_000, "calls": 20, "concurrency": 2, "ttl_seconds": 600,
    },
    {
        "profile": "simulation",
        "resources": [],
        "tools": [],
        "recipients_allow": [],
        "models": ["mock/echo"], "tokens": 1_000_000, "calls": 1_000, "concurrency": 100, "ttl_seconds": 300,
    },
]
TASK_PROFILE_SCHEMA = (
    "profile string, resources array<string>, tools array<string>, recipients_allow array<string>, "
    "models array<string>, tokens bigint, calls bigint, concurrency int, ttl_seconds int"
)
