"""Rule ids, weights, word lists, patterns and formats that results depend on."""

from __future__ import annotations

from dataclasses import dataclass

# --- fixed values -----------------------------------------------------------

CATEGORIES = ("naming", "install", "code", "lockfile", "registry", "provenance", "intel", "campaign")

#: Lowest score of each severity.
SEVERITIES = ((85, "critical"), (60, "high"), (30, "medium"), (1, "low"), (0, "clean"))
SEVERITY_ORDER = ("clean", "low", "medium", "high", "critical")
SARIF_LEVELS = {"critical": "error", "high": "error", "medium": "warning", "low": "note"}

#: A category counts its heaviest finding and this share of the others.
REST_SHARE = 0.4
#: Every further category raises the sum by this share.
CATEGORY_BONUS = 0.25


@dataclass(frozen=True)
class RuleInfo:
    id: str
    category: str
    weight: int
    title: str
    online: bool = False
    certain: bool = False
    fix: str = ""


RULES = (
    RuleInfo("HEM101", "naming", 30, "Name is a near-miss of a popular package", fix="Check the name against the one you meant, and what asked for it."),
    RuleInfo("HEM102", "naming", 22, "Popular name plus a plausible-looking affix", fix="Look the package up in the project's own documentation."),
    RuleInfo("HEM103", "naming", 55, "Name contains a look-alike character", fix="Remove it; no honest name needs such a character."),
    RuleInfo("HEM104", "naming", 28, "Unscoped copy of a scoped package name", fix="Use the scoped name if that is the one you meant."),
    RuleInfo("HEM201", "install", 18, "Runs a script at install time", fix="Install without scripts unless the package needs them."),
    RuleInfo("HEM202", "install", 45, "Install script downloads and executes", fix="Read what it fetches before you install it."),
    RuleInfo("HEM203", "install", 40, "Install script decodes an encoded payload", fix="Remove the package."),
    RuleInfo("HEM204", "install", 50, "Install script touches credentials", fix="Rotate every credential that it could read."),
    RuleInfo("HEM301", "code", 35, "Source looks deliberately unreadable", fix="Compare what was published with the repository."),
    RuleInfo("HEM302", "code", 25, "Builds code at runtime", fix="Check whether running built code is what the package is for."),
    RuleInfo("HEM401", "lockfile", 12, "Version is not pinned", fix="Pin the version and commit a lockfile."),
    RuleInfo("HEM402", "lockfile", 20, "Lockfile entry has no integrity hash", fix="Write the lockfile anew, with hashes."),
    RuleInfo("HEM403", "lockfile", 30, "Resolved over plain HTTP", fix="Use a registry over https."),
    RuleInfo("HEM404", "lockfile", 22, "Installed from outside the registry", fix="Pin a commit, or use a published release."),
    RuleInfo("HEM405", "lockfile", 25, "An additional package index is configured", fix="Replace the default index instead of adding one."),
    RuleInfo("HEM501", "registry", 25, "This version was published very recently", online=True, fix="Wait, or read the changes first."),
    RuleInfo("HEM502", "registry", 45, "Published by a different account than usual", online=True, fix="See whether the project names its new publisher."),
    RuleInfo("HEM503", "registry", 25, "Deprecated or withdrawn", online=True, fix="Move to what the notice points at."),
    RuleInfo("HEM504", "registry", 20, "Almost nobody installs this", online=True, fix="Find out what asked for it."),
    RuleInfo("HEM505", "registry", 15, "No source repository", online=True, fix="Prefer a package with readable source."),
    RuleInfo("HEM506", "registry", 25, "Release size jumped sharply", online=True, fix="Find out what was added."),
    RuleInfo("HEM507", "registry", 35, "The registry has no package by this name", online=True, fix="Check the spelling; claim the name if it is yours."),
    RuleInfo("HEM601", "provenance", 20, "Published without build provenance", online=True, fix="Nothing to do, but the release cannot be traced to its source."),
    RuleInfo("HEM602", "provenance", 55, "Provenance points at a different repository", online=True, fix="Ask the maintainers whose repository built it."),
    RuleInfo("HEM701", "intel", 100, "This exact version is reported as malware", online=True, certain=True, fix="Remove it and rotate what an install could reach."),
    RuleInfo("HEM702", "intel", 30, "Published advisory against this version", online=True, fix="Upgrade past the affected versions."),
    RuleInfo("HEM801", "campaign", 55, "Shares an install payload with other packages", fix="Remove all of them at once and rotate credentials."),
    RuleInfo("HEM802", "campaign", 45, "Shares an install-time endpoint with others", fix="Find out whose host it is; rotate if you cannot."),
    RuleInfo("HEM803", "campaign", 35, "One new account behind several packages", online=True, fix="Ask whether the account belongs to the projects."),
)

#: Rules whose finding names a report's headline, most alarming first.
HEADLINE_ORDER = (
    "HEM701", "HEM801", "HEM802", "HEM204", "HEM602", "HEM202", "HEM203", "HEM803", "HEM502",
    "HEM103", "HEM507", "HEM301", "HEM101", "HEM702", "HEM201",
)

AFFIXES = {
    "npm": ("js", "node", "nodejs", "npm", "core", "cli", "lib", "sdk", "official", "dev", "ts"),
    "pypi": ("py", "python", "python3", "lib", "sdk", "cli", "core", "official", "dev", "api"),
}

LOOK_ALIKES = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c",
    "х": "x", "у": "y", "і": "i", "ј": "j", "һ": "h",
    "ο": "o", "α": "a", "ρ": "p", "ɡ": "g", "ᴉ": "i",
    "‐": "-", "‑": "-", "‒": "-", "–": "-", "—": "-",
}

SCOPE_HEADS = ("types", "babel", "angular", "vue", "nestjs")

HOOKS = ("preinstall", "install", "postinstall", "prepare", "prepublish")

CREDENTIAL_MARKS = (
    "~/.ssh", ".ssh/id_", "~/.aws", ".aws/credentials", "~/.npmrc", ".npmrc",
    "~/.docker/config", ".git-credentials", "~/.kube/config", ".pypirc",
    "id_rsa", "id_ed25519", "security find-generic-password", "login.keychain",
    "GITHUB_TOKEN", "NPM_TOKEN", "AWS_SECRET", "AWS_ACCESS_KEY",
    "/etc/shadow", "wallet.dat", "Local Storage/leveldb",
)

COMMON_HOSTS = (
    "registry.npmjs.org", "registry.yarnpkg.com", "npmjs.com", "www.npmjs.com",
    "pypi.org", "files.pythonhosted.org", "test.pypi.org",
    "github.com", "www.github.com", "raw.githubusercontent.com", "objects.githubusercontent.com",
    "codeload.github.com", "api.github.com", "gitlab.com", "bitbucket.org",
    "nodejs.org", "registry.npmmirror.com", "unpkg.com", "cdn.jsdelivr.net", "jsdelivr.net",
    "npmmirror.com", "googleapis.com", "storage.googleapis.com",
    "localhost", "127.0.0.1", "example.com",
)
REGISTRY_HOSTS = ("registry.npmjs.org", "files.pythonhosted.org")

#: Patterns in the syntax that Java and Python share.
FETCH_AND_RUN = (
    r"(curl|wget|Invoke-WebRequest|iwr)\b[^\n|;]{0,200}[|;]\s*(sudo\s+)?(ba|z|d|)?sh\b"
    r"|(curl|wget)\b[^\n]{0,200}-o\s*\S+[^\n]{0,80};\s*(chmod|\./|sh\s)"
    r"|node\s+-e\s+[\"'].{0,40}(http|require\()"
    r"|python3?\s+-c\s+[\"'].{0,40}(urllib|requests|socket)"
)
DECODE_AND_EXECUTE = (
    r"(base64\s+(-d|--decode)|atob\s*\(|Buffer\.from\([^)]*base64|b64decode|codecs\.decode|fromCharCode)"
    r"[\s\S]{0,300}?(eval|exec|Function\s*\(|child_process|spawn|subprocess|os\.system)"
    r"|(eval|exec)[\s\S]{0,80}(atob|base64|b64decode|fromCharCode)"
)
DYNAMIC_CODE = (
    r"\beval\s*\(\s*(?!['\"]?\s*\))|new\s+Function\s*\(|"
    r"\bexec\s*\(\s*(?:[a-z_]\w*\s*[+%]|f['\"])|__import__\s*\("
)
LONG_BLOB = r"['\"][A-Za-z0-9+/=_-]{500,}['\"]"
OUTSIDE_REGISTRY = r"^(git\+|git:|file:|link:|https?://)"
RANGE_SPEC = r"[\^~*><|\s]|latest|^\d+\.x"
REQUIREMENT = r"^([A-Za-z0-9][A-Za-z0-9._-]*)(?:\[[^\]]+\])?\s*((?:[=<>!~^]=?|===)\s*[^;#\s]+)?"
INDEX_OPTION = r"^(?:--index-url|--extra-index-url|-i)(?:\s+|=)(\S+)"
CODE_URL = r"^(git|hg|svn|bzr)\+|^https?://"
URL_HOST = r"\bhttps?://([A-Za-z0-9._-]+(?::\d+)?)"
SCRIPT_FILE = r"[\w./@-]+\.(?:js|cjs|mjs|py)\b"

NPM_MANIFESTS = ("package-lock.json", "npm-shrinkwrap.json", "yarn.lock", "package.json")
PYPI_MANIFESTS = ("poetry.lock", "Pipfile.lock", "requirements.txt", "pyproject.toml")
NPM_SKIPPED = (".git", "node_modules", ".venv", "venv", "__pycache__", "dist", "build", ".tox")
PYPI_SKIPPED = (".git", "node_modules", "__pycache__", "dist", "build", ".tox", ".mypy_cache")
HASHED_LOCKFILES = ("package-lock.json", "npm-shrinkwrap.json", "Pipfile.lock")

SOURCE_SUFFIXES = (".js", ".mjs", ".cjs", ".ts", ".py")
SOURCE_SKIPPED = ("node_modules", "test", "tests", "__pycache__")
BUNDLE_FOLDERS = ("dist", "build", "bundle", "umd", "esm")
SOURCE_FILES_MOST, SOURCE_BYTES_MOST, INSTALL_FILES_MOST = 40, 2_000_000, 8

#: Sketches: tokens of a gram, hashes of a window, least tokens and prints of a file.
GRAM, WINDOW, LEAST_TOKENS, LEAST_PRINTS = 9, 6, 120, 12
PRINT_BASE, PRINT_PRIME = 1_000_003, (1 << 61) - 1
#: Links: least shared prints and containment, most owners of a shared value, most files of a print's bucket.
SHARED_LEAST, CONTAINED_LEAST, CROWD_MOST, BUCKET_MOST = 8, 0.80, 60, 64
BURST_HOURS = 72
CROWD_LEAST = 5

LANGUAGES = {".js": "js", ".mjs": "js", ".cjs": "js", ".ts": "js", ".tsx": "js", ".jsx": "js", ".py": "py", ".pyi": "py"}

LINK_KINDS = ("payload", "endpoint", "publisher")
PROVENANCE_SINCE = "2025-01-01 00:00:00"
FAIL_LEVELS = ("low", "medium", "high", "critical", "never")
# --- end of fixed values ----------------------------------------------------

RULE_BY_ID = {r.id: r for r in RULES}
