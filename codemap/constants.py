"""Fixed values.

Every list below is a fixed value that must equal the analysed behaviour for
results to match (file-name sets, extension sets, hint words, thresholds).
They are stated plainly, in natural order, and used only as data.
"""

# ---------------------------------------------------------------------------
# FIXED VALUES: ingestion
# ---------------------------------------------------------------------------
SIGNAL_FILENAMES = [
    "Dockerfile", "docker-compose.yml", "docker-compose.yaml",
    "package.json", "requirements.txt", "go.mod", "pom.xml",
    "Cargo.toml", "Makefile", ".env.example", "tsconfig.json",
    "webpack.config.js", "vite.config.js", "setup.py", "pyproject.toml",
    "setup.cfg", "Pipfile", "Pipfile.lock", "poetry.lock",
    "README.md",
]
SOURCE_EXTENSIONS = [".py", ".js", ".jsx", ".ts", ".tsx"]
SKIP_EXTENSIONS = [
    ".png", ".jpg", ".jpeg", ".gif", ".svg", ".ico", ".woff",
    ".woff2", ".ttf", ".eot", ".mp4", ".mp3", ".pdf", ".zip",
    ".lock", ".sum",
]
SKIP_DIRS = [
    "node_modules", ".git", "__pycache__", ".venv", "venv",
    "dist", "build", ".next", ".nuxt",
]
ALWAYS_FETCH_FILENAMES = [
    "applications.py", "routing.py", "api.py", "core.py",
    "app.py", "main.py", "server.py", "cli.py",
    "__main__.py", "__init__.py", "wsgi.py", "asgi.py", "manage.py", "run.py",
    "index.js", "index.ts", "server.js", "server.ts",
    "app.js", "app.ts", "main.go", "main.rs",
    "train.py", "predict.py", "inference.py", "pipeline.py", "model.py",
]
MAX_FILE_SIZE = 300_000
MAX_SOURCE_FILES = 150
DEFAULT_BRANCH = "main"

# ---------------------------------------------------------------------------
# FIXED VALUES: import parsing and noise paths
# ---------------------------------------------------------------------------
NOISE_DIRS = [
    "tests", "test", "examples", "docs", "docs_src", ".github", "__pycache__",
    "build", "dist", "node_modules", ".venv", "venv", "scripts",
]
NOISE_FILE_PREFIXES = ["test_"]
NOISE_FILE_SUFFIXES = ["_test.py", ".spec.js", ".test.js"]
NOISE_FILES = ["conftest.py"]
# relative-import candidates, in priority order: (suffix appended to dir/clean)
RELATIVE_CANDIDATE_SUFFIXES = [".py", ".js", "/index.js", ".ts", ".tsx"]
ABSOLUTE_CANDIDATE_SUFFIXES = [".py", ".js"]

# ---------------------------------------------------------------------------
# FIXED VALUES: languages
# ---------------------------------------------------------------------------
EXTENSION_TO_LANGUAGE = [
    (".py", "python"), (".js", "javascript"), (".ts", "typescript"),
    (".jsx", "javascript"), (".tsx", "typescript"), (".go", "go"),
    (".rs", "rust"), (".java", "java"), (".rb", "ruby"), (".cpp", "cpp"),
    (".c", "c"), (".cs", "c_sharp"), (".php", "php"),
]

# ---------------------------------------------------------------------------
# FIXED VALUES: context inference scoring
# ---------------------------------------------------------------------------
IMPORTANT_HINTS = [
    "main", "app", "cli", "route", "routing", "application",
    "api", "server", "openapi", "security", "dependency",
    "request", "response", "views", "models", "schemas", "core",
]
ENTRY_FILE_NAMES = [
    "main.py", "app.py", "cli.py", "server.py", "manage.py", "run.py",
    "index.js", "index.ts", "server.js", "server.ts",
    "main.go", "main.rs", "main.java",
    "main.c", "main.cc", "main.cpp", "main.cxx",
    "program.cs",
]
FRAMEWORK_CORE_NAMES = [
    "applications.py", "routing.py", "api.py", "core.py",
    "router.py", "server.py", "wsgi.py", "asgi.py",
    "urls.py", "handlers.py",
]
VALID_EXTENSIONS = [
    ".py", ".js", ".jsx", ".ts", ".tsx",
    ".java", ".go", ".rb", ".php",
    ".c", ".cc", ".cpp", ".cxx", ".cs", ".rs",
]
STARTUP_SIGNALS = [
    'if __name__ == "__main__"',
    "if __name__ == '__main__'",
    "app.listen(",
    "createserver(",
    "express(",
    "fastapi(",
    "flask(",
    "typer(",
    "click.command",
    "argparse",
    "int main(",
    "public static void main",
    "package main",
    "func main(",
]
ENTRY_NAME_TOKENS = ["main", "app", "server", "cli", "manage", "run", "index"]
DOC_CONFIG_SUFFIXES = [".md", ".rst", ".toml", ".txt", ".yml", ".yaml", ".json"]
KEYWORD_TERMS = [
    "api", "application", "routing", "request", "response", "cli",
    "security", "authentication", "authorization", "openapi",
    "validation", "dependencies", "models", "serialization",
    "http", "server", "client", "parser", "build", "database",
]
DEFAULT_KEYWORDS = ["api", "application", "routing", "request", "response", "cli"]
DEFAULT_MODULES = [
    "application setup", "routing", "request handling", "response handling", "CLI",
]
CONTEXT_FILES_TOP_N = 15
CONTEXT_CENTRAL_TOP_N = 30
REPORT_CENTRAL_TOP_N = 10
MAX_MODULES = 8
MAX_ENTRY_POINTS = 5
MAX_KEYWORDS = 12
EXCERPT_CHARS = 800
SIGNAL_EXCERPT_CHARS = 1200
PROMPT_TREE_FILES = 250
PROMPT_EXCERPTS = 15

# ---------------------------------------------------------------------------
# FIXED VALUES: retrieval
# ---------------------------------------------------------------------------
MIN_FILES = 6
MAX_FILES = 10
TOKEN_BUDGET_DEFAULT = 24000
API_TOKEN_BUDGET = 8000
MAX_CHARS_PER_FILE = 6000
TRUNCATION_MARKER = "\n\n# ... (file continues)"
CHARS_PER_TOKEN = 4
SEMANTIC_SHORTLIST = 50
BM25_K1 = 1.5
BM25_B = 0.75
BM25_EPSILON = 0.25
PENALTY_SUBSTRINGS = [
    "tests/", "test_", "/tests/", "examples/", "docs/", "doc/",
    "/example/", "/tutorial/", "/sample/", "__pycache__/",
]
PENALTY_SUFFIXES = [".md", ".rst", ".txt", ".yml", ".yaml", ".toml", ".cfg"]
PENALTY_STRONG = 0.2
PENALTY_WEAK = 0.5
ENTRY_BONUS = 1.5
WEIGHT_PAGERANK = 0.4
WEIGHT_BM25 = 0.4
WEIGHT_SEMANTIC = 0.2
PRERANK_WEIGHT = 0.5

# PageRank defaults of the graph library the analysis relies on
PAGERANK_ALPHA = 0.85
PAGERANK_MAX_ITER = 100
PAGERANK_TOL = 1.0e-6

# ---------------------------------------------------------------------------
# FIXED VALUES: evidence extraction (regular expressions)
# ---------------------------------------------------------------------------
ROUTE_PATTERN = r"""@\w+\.route\(["'](.+?)["']\)"""
VERB_ROUTE_PATTERN = r"""@\w+\.(get|post|put|delete|patch)\(["'](.+?)["']\)"""
DEF_PATTERN = r"^(?:async )?def (\w+)\("
CLASS_PATTERN = r"^class (\w+)"
DB_CALL_PATTERN = r"(db\.\w+|Model\.query|session\.\w+|\.objects\.\w+)"
EVIDENCE_CAP = 20

# ---------------------------------------------------------------------------
# FIXED VALUES: model replies and report
# ---------------------------------------------------------------------------
COMPRESSED_FOLDER_TEXT = " files (not included in detail)"
UNPARSEABLE_ARCHITECTURE = "graph TD\n  error[Could not parse LLM response]"
GITHUB_HOSTS = ["github.com", "www.github.com"]
