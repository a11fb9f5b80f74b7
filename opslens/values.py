"""Constants, patterns, labels and formats that results depend on."""

# --- Fixed values: trailing window ---------------------------------------------------------------
WINDOW_DAYS = 7

# --- Fixed values: default rows ------------------------------------------------------------------
ACTIVITY_FIELDS = ["prs_submitted", "lines_added", "lines_deleted", "bugs_closed", "releases_done"]
UNKNOWN_MODEL = "unknown"
DEFAULT_MODELS = {
    "openai": "gpt-4-turbo",
    "anthropic": "claude-3-opus",
    "gemini": "gemini-1.5-pro",
}
AI_PROVIDERS = ["openai", "anthropic", "gemini"]
CLOUD_PROVIDERS = ["aws", "gcp"]
DEFAULT_PROJECT_ID = "default-proj"

# --- Fixed values: error texts -------------------------------------------------------------------
MISSING_TOKEN_OR_REPO = "Missing token or repo"
INVALID_REPO_FORMAT = "Invalid repo format. Expected owner/repo"
REPOSITORY_NOT_FOUND = "Repository not found"
QUERY_ERROR_PREFIX = "GraphQL error: "
UNKNOWN_QUERY_ERROR = "Unknown error"
API_ERROR_PREFIX = "API error: "
MISSING_API_KEY = "Missing API key"
MISSING_CREDENTIALS = {"aws": "Missing AWS credentials", "gcp": "Missing GCP credentials"}

# --- Fixed values: log patterns ------------------------------------------------------------------
TRACE_PATTERNS = [
    r"Traceback \(most recent call last\):",
    r"panic: ",
    r"AssertionError",
    r"panicked at",
    r"stack backtrace:",
    r"Exception in thread",
    r"\w+Exception:",
    r"(TypeError|ReferenceError|SyntaxError|Error):",
]
TRACE_ROWS = 100
TAIL_ROWS = 40
VENDOR_PATTERNS = ["node_modules/", "venv/", "site-packages/", "/lib/python", "/usr/lib/", "external/"]
ERROR_KEYWORDS = ["Exception", "Error:", "Traceback", "FAILED", "AssertionError", "ERROR", "CRITICAL"]
FAILURE_PATTERNS = ["AssertionError", "FAILED", "E       ", "Traceback", "Exception:", "Error:"]
INTAKE_CHARS = 2000
INTAKE_MARKERS = ["Traceback", "at ", "Exception"]

# --- Fixed values: text accounting ---------------------------------------------------------------
CHARS_PER_TOKEN = 4
MIN_SHARED_LINE_CHARS = 20
CONTEXT_PREFIX_CHARS = 5000
SNIPPET_CHARS = 150
ITEMS_PER_CHUNK = 40
ID_HEX_CHARS = 12

# --- Fixed values: documents ---------------------------------------------------------------------
CORE_DOCUMENTS = ["index.md", "architecture.md"]
DOCUMENT_SUFFIX = ".md"
TEMPLATE_SUFFIXES = [".md", ".json", ".yaml", ".yml"]
IGNORED_NAMES = [".git", "__pycache__", ".DS_Store"]
IGNORED_SUFFIX = ".log"
PLACEHOLDER_LEFT = "[USER INPUT REQUIRED]"
SKILLS_HEADING = "## Proposed Skills"
MCPS_HEADING = "## Proposed MCP Tools"
NO_SKILLS_LINE = "- [ ] No skills recommended"
NO_MCPS_LINE = "- [ ] No MCPs recommended"
DEFAULT_OWNER = "domain-sme"
NO_SECTION_TEXT = "None provided."
DEFAULT_INVARIANTS = "1. [USER INPUT REQUIRED: Add your own unbreakable rule here]\n"
DEFAULT_GLOSSARY = "*   **[Term 1]**: [USER INPUT REQUIRED: Define this term]\n"
DEFAULT_EVENTS = "*   **[USER INPUT REQUIRED]**"
ROUTING_FILE = "dispatch_rules.md"
ROUTING_MARKER = "**Negative Routing Rules"
ROUTING_FORMAT = (
    "\n- **Domain Specific Routing**: If the task involves domain-specific areas similar to the domains defined by "
    "the newly minted specialized agents (%s), you MUST route to those agents. Refer to their markdown files in the "
    "agents directory for their specific mandates.\n"
)
TEMPLATE_SLOTS = [
    "TECH_STACK",
    "DOMAIN_SUMMARY",
    "SME_NAME",
    "CORE_DOMAIN_VALUE",
    "INVARIANTS",
    "GLOSSARY",
    "DOMAIN_EVENTS",
    "SKILLS_MD",
    "MCPS_MD",
]

# --- Fixed values: file name to technology label -------------------------------------------------
TECH_MARKERS = {
    "package.json": "Node.js/JavaScript",
    "tsconfig.json": "Node.js/TypeScript",
    "requirements.txt": "Python",
    "pyproject.toml": "Python",
    "Pipfile": "Python",
    "setup.py": "Python",
    "Cargo.toml": "Rust",
    "go.mod": "Go",
    "pom.xml": "JVM (Java/Kotlin)",
    "build.gradle": "JVM (Java/Kotlin)",
    "composer.json": "PHP",
}
MANIFEST_DEPTH = 2
JAVASCRIPT = "Node.js/JavaScript"
TYPESCRIPT = "Node.js/TypeScript"
NODE = "Node.js"
FRONTEND = "Frontend"
UNKNOWN_STACK = "Unknown Stack"

# --- Fixed values: ordered text replacements per platform ----------------------------------------
PLATFORM_RULES = {
    "claude": [
        ("- read_file", "- Read"),
        ("- grep_search", "- Grep"),
        ("- replace", "- Edit"),
        ("- write_file", "- Write"),
        ("- run_shell_command", "- Bash"),
        ("- glob", "- Glob"),
        ("read_file", "Read"),
        ("grep_search", "Grep"),
        ("replace", "Edit"),
        ("write_file", "Write"),
        ("run_shell_command", "Bash"),
        ("glob", "Glob"),
        ("{{SUBAGENT_SYNTAX}}", "Task tool: "),
    ],
    "codex": [("{{SUBAGENT_SYNTAX}}", "Hand off to ")],
    "default": [("{{SUBAGENT_SYNTAX}}", "@")],
}
FOLDER_SLOT = "{{HARNESS_DIR}}"
FOLDER_MENTION = "@boilerplate-agent"

# --- Fixed values: artifact paths and violations -------------------------------------------------
DIAGNOSIS_REPORT = "artifacts/diagnosis_report.md"
PLAN_CANDIDATES = ["artifacts/implementation_plan.md", "artifacts/plan.md"]
FAILING_TEST_LOG = "artifacts/tdd_failing_test.log"
REVIEW_REPORT = "artifacts/code_review_report.md"
QA_REPORT = "artifacts/qa_report.md"
ROOT_CAUSE_TEXT = "Root Cause"
REPRODUCIBLE_TEXT = "reproducible"
PLAN_HEADINGS = ["## Sphinch Marks", "## Verification Criteria"]
NO_DIAGNOSIS = "%s is missing. You MUST perform a diagnosis before discovery."
WEAK_DIAGNOSIS = "%s lacks a clear Root Cause or reproduction steps."
NO_PLAN = "No implementation plan found in artifacts/."
WEAK_PLAN = "Plan in %s is missing strict Verification Criteria (Sphinch Marks)."
NO_PLAN_TO_EXECUTE = "MISSING ARTIFACT: %s (Required for Phase 4)"
NO_FAILING_TEST = "MISSING ARTIFACT: %s (Required to prove TDD Hard Gate)"
NO_FAILURE_IN_LOG = (
    "INVALID ARTIFACT: %s does not contain a verifiable failure trace. You must run the tests and capture the "
    "failure before implementation."
)
NO_REPORT = "MISSING ARTIFACT: %s"

# --- Fixed values: report formats ----------------------------------------------------------------
HEADER_FORMAT = "Project Report: %s"
FALLBACK_TEXT_FORMAT = "Report for %s"
ACTIVITY_FORMAT = (
    "🛠️ *Engineering Metrics (GitHub)*\n"
    "• *PRs Submitted:* %d\n"
    "• *Lines Added:* %d\n"
    "• *Lines Deleted:* %d\n"
    "• *Bugs Closed:* %d\n"
    "• *Releases:* %d"
)
# Money is formatted before it is inserted: 4 digits for usage, 2 for infrastructure.
USAGE_TITLE = "🤖 *AI Usage Metrics*"
USAGE_FORMAT = "• *%s*: model `%s` | In: %d | Out: %d | Cost: $%s"
COST_TITLE = "☁️ *Infrastructure Costs*"
COST_FORMAT = "• *%s:* $%s"
WARNING_FORMAT = ":warning: _%s_"

# Own texts of this library, for input that cannot be read.
MALFORMED_RECORD = "Malformed record"
UNREADABLE_FILE = "Unreadable file"
UNREADABLE_SOURCE = "unreadable"
