"""Explicit schemas of the landing data. Nothing is inferred in a job."""

from opslens.functions.money import MONEY

ACTIVITY_BODY = (
    "struct<"
    "errors: array<struct<message: string>>,"
    "data: struct<repository: struct<"
    "pullRequests: struct<nodes: array<struct<createdAt: string, mergedAt: string, additions: bigint, deletions: bigint>>>,"
    "issues: struct<nodes: array<struct<closedAt: string>>>,"
    "releases: struct<nodes: array<struct<createdAt: string>>>"
    ">>>"
)
ACTIVITY = f"repo string, has_token boolean, http_status int, exception string, body {ACTIVITY_BODY}"

USAGE_BODY = "struct<tokens_in: bigint, tokens_out: bigint, prompts: bigint, cost: string, model: string>"
USAGE = f"provider string, has_key boolean, http_status int, exception string, fetched_at string, body {USAGE_BODY}"

COST_BODY = "struct<ResultsByTime: array<struct<Total: struct<UnblendedCost: struct<Amount: string>>>>>"
COST = f"provider string, has_credentials boolean, exception string, fetched_at string, body {COST_BODY}"

PROJECT_CONFIG = "map<string, map<string, string>>"

TOOL_FIELDS = (
    "name: string, url: string, command: string, type: string, keywords: array<string>, force_if_keywords: array<string>"
)
TOOL = f"struct<{TOOL_FIELDS}>"
FLAT_TOOL = f"struct<category: string, {TOOL_FIELDS}>"
REGISTRY = f"struct<categories: map<string, array<{TOOL}>>>"

SUGGESTION = "struct<name: string, url: string, command: string, type: string>"
PROFILE_FIELDS = (
    "sme_name: string, core_domain_value: string, invariants: array<string>, glossary: map<string, string>,"
    " domain_events: array<string>"
)
PROFILE = f"struct<{PROFILE_FIELDS}>"
REPLY = f"struct<{PROFILE_FIELDS}, skills: array<{SUGGESTION}>, mcps: array<{SUGGESTION}>>"

ACTIVITY_STATS = (
    "struct<prs_submitted: bigint, lines_added: bigint, lines_deleted: bigint, bugs_closed: bigint, releases_done: bigint>"
)
USAGE_STATS = f"struct<model: string, tokens_in: bigint, tokens_out: bigint, prompts: bigint, cost: {MONEY}>"
COST_STATS = f"struct<cost: {MONEY}, status: string>"
