"""Names, paths and patterns that decide which files and functions matter. Kept as they must be for equal
results."""

EXCLUDES = (
    ".github", ".vscode", ".git", ".gitignore", ".gitmodules", "examples", "*.pyc", "*.pyo", "*.pyd", "__pycache__", ".pytest_cache", ".coverage",
    ".tox", ".nox", ".mypy_cache", ".ruff_cache", ".hypothesis", "poetry.lock", "Pipfile.lock", "package-lock.json", "yarn.lock", ".npm", ".yarn",
    ".pnpm-store", "bun.lock", "bun.lockb", "*.class", "*.jar", "*.war", "*.ear", "*.nar", ".gradle/", ".settings/", ".classpath",
    "gradle-app.setting", "*.gradle", ".project", "*.o", "*.obj", "*.dll", "*.dylib", "*.exe", "*.lib", "*.out", "*.a", "*.pdb", "*.suo", "*.user",
    "*.userosscache", "*.sln.docstates", "*.nupkg", "bin/", ".svn", ".hg", ".gitattributes", "*.svg", "*.png", "*.jpg", "*.jpeg", "*.gif", "*.ico",
    "*.pdf", "*.mov", "*.mp4", "*.mp3", "*.wav", "venv", ".venv", "env", ".env", "virtualenv", ".idea", ".vs", "*.swo", "*.swn", "*.sublime-*",
    "*.log", "*.bak", "*.swp", "*.tmp", "*.temp", ".cache", ".sass-cache", ".DS_Store", "Thumbs.db", "desktop.ini", "*.egg-info", "*.egg", "*.whl",
    "*.so", ".docusaurus", "*.min.js", "*.min.css", "*.map", ".terraform", "*.tfstate*", "digest.txt", "*.ini", "tests", "test", "Tests", "Test",
    "Examples",
)

INCLUDES = (
    "*.py", "*.js", "*.ts", "*.jsx", "*.tsx", "*.java", "*.cpp", "*.c", "*.h", "*.cs", "*.go", "*.rs", "*.php", "*.rb", "*.swift", "*.kt", "*.scala",
    "*.clj", "*.hs", "*.ml", "*.html", "*.css", "*.scss", "*.sass", "*.json", "*.yaml", "*.yml", "*.xml", "*.md", "*.txt", "*.toml", "*.cfg", "*.ini",
)

ENTRY_FILES = (
    "main.py", "app.py", "server.py", "__main__.py", "run.py", "start.py", "manage.py", "wsgi.py", "asgi.py", "gunicorn.py", "index.js", "app.js",
    "server.js", "main.js", "index.ts", "app.ts", "server.ts", "main.ts", "start.js", "start.ts", "bootstrap.js", "bootstrap.ts", "entry.js",
    "entry.ts", "main.go", "cmd.go", "server.go", "app.go", "root.go", "start.go", "main.rs", "lib.rs", "server.rs", "app.rs", "start.rs", "bin.rs",
    "main.c", "main.cpp", "main.cc", "main.cxx", "app.c", "app.cpp", "start.c", "start.cpp", "entry.c", "entry.cpp",
)

ENTRY_PATHS = (
    "cmd/main", "cmd/root", "cmd/server", "src/main", "src/app", "src/server", "bin/main", "bin/app", "bin/server", "app/main", "app/server",
    "app/start", "scripts/start", "scripts/run",
)

ENTRY_WORDS = (
    "main", "app", "server", "start", "run", "entry", "bootstrap", "init", "cmd", "cli", "daemon", "service", "worker", "launcher",
)

ENTRY_EXTENSIONS = (
    ".py", ".js", ".ts", ".go", ".rs", ".c", ".cpp",
)

CONNECTED_WORDS = (
    "router", "controller", "service", "handler", "middleware", "api", "core", "engine", "manager", "processor", "client", "mod", "module", "pkg",
    "package", "lib", "util", "utils", "helper", "helpers", "express", "fastapi", "gin", "actix", "rocket", "db", "database", "model", "entity",
    "repo", "repository", "config", "settings", "constants", "types", "interfaces", "console", "text", "style", "render", "display", "format",
    "parse", "parser", "convert", "transform", "process", "table", "tree", "list", "grid", "layout", "widget", "color", "theme", "visual", "graphic",
    "draw", "paint", "file", "io", "stream", "buffer", "cache", "store", "base", "common", "shared", "global", "main", "index",
)

SOURCE_DIRS = (
    "src/", "lib/", "core/", "pkg/", "cmd/", "internal/", "crates/", "modules/", "include/", "source/", "components/", "services/", "utils/",
)

DEFINITIONS = {
    "python": ["def {name}"],
    "javascript": ["function {name}", "const {name}", "export {name}"],
    "typescript": ["function {name}", "const {name}", "export {name}"],
    "go": ["func {name}"],
    "rust": ["fn {name}", "pub fn {name}"],
    "c": ["void {name}", "int {name}", "{name}("],
    "cpp": ["void {name}", "int {name}", "{name}("],
    "general": ["{name}("],
}

CRITICAL_NAMES = (
    "main", "index", "app", "server", "start", "init", "run", "new",
)

EXPORTS = (
    "export default", "module.exports =", "exports.", "pub fn main", "pub fn new", "pub fn", "func main", "func new", "int main", "void main",
    "public static void main", 'if __name__ == "__main__"',
)

FALLBACK_WORDS = (
    "main", "app", "server", "start", "index",
)

FALLBACK_DIRS = (
    "src/", "lib/", "app/", "pkg/", "core/",
)
