"""Classification tables, stop words, verbs and patterns that results depend on."""

# Categories by extension.
EXT_CATEGORY = {
    ".js": "code", ".jsx": "code", ".ts": "code", ".tsx": "code", ".mjs": "code", ".cjs": "code", ".vue": "code", ".svelte": "code",
    ".json": "config", ".yaml": "config", ".yml": "config", ".toml": "config", ".ini": "config", ".conf": "config", ".config": "config",
    ".lock": "config", ".css": "style", ".scss": "style", ".sass": "style", ".less": "style", ".styl": "style", ".stylus": "style", ".pcss": "style",
    ".md": "docs", ".markdown": "docs", ".html": "docs", ".htm": "docs", ".txt": "docs", ".rst": "docs", ".adoc": "docs",
    ".png": "media", ".jpg": "media", ".jpeg": "media", ".gif": "media", ".svg": "media", ".webp": "media", ".ico": "media", ".avif": "media",
    ".bmp": "media", ".tiff": "media", ".tif": "media", ".raw": "media", ".heic": "media", ".heif": "media", ".mp4": "media", ".mov": "media",
    ".webm": "media", ".avi": "media", ".mkv": "media", ".flv": "media", ".wmv": "media", ".mp3": "media", ".wav": "media", ".aac": "media",
    ".ogg": "media", ".flac": "media", ".m4a": "media", ".wma": "media", ".aiff": "media", ".zip": "archive", ".tar": "archive", ".gz": "archive",
    ".bz2": "archive", ".xz": "archive", ".7z": "archive", ".rar": "archive", ".tgz": "archive", ".ttf": "font", ".otf": "font", ".woff": "font",
    ".woff2": "font", ".eot": "font", ".pdf": "binary", ".doc": "binary", ".docx": "binary", ".xls": "binary", ".xlsx": "binary", ".ppt": "binary",
    ".pptx": "binary", ".exe": "binary", ".dll": "binary", ".so": "binary", ".dylib": "binary", ".wasm": "binary",
    ".sql": "database", ".db": "database", ".sqlite": "database",
}
# Languages by extension.
EXT_LANGUAGE = {
    ".js": "javascript", ".mjs": "javascript", ".cjs": "javascript", ".jsx": "javascriptreact", ".ts": "typescript",
    ".tsx": "typescriptreact", ".vue": "vue", ".svelte": "svelte", ".json": "json", ".yaml": "yaml", ".yml": "yaml",
    ".toml": "toml", ".ini": "ini", ".css": "css", ".scss": "scss", ".sass": "sass", ".less": "less", ".md": "markdown", ".markdown": "markdown",
    ".html": "html", ".htm": "html", ".txt": "text", ".rst": "restructuredtext", ".sql": "sql", ".svg": "svg",
}
# Names with a category of their own.
SPECIAL = {
    "config": [".env", ".env.example", ".env.local", ".env.development", ".env.production", ".gitignore", ".npmignore", ".eslintrc", ".prettierrc", "Dockerfile", "Makefile"],
    "docs": ["README"],
}
HARD_SKIP = ["archive", "font", "binary"]
CODE_EXTS = [".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs"]
FS_EXTS = [".js", ".jsx", ".ts", ".tsx", ".mjs", ".cjs", ".json"]
ROUTE_ROOTS = ["app/", "pages/", "src/app/", "src/pages/"]
WEIGHTS = {"direct": 100, "indirect": 50, "package": 80, "circular": 200, "route": 60, "layout": 90}
# Path patterns of files that are not described.
SKIP_PATHS = [r"\.lock$", r"\.min\.", r"\.bundle\.", r"chunk-[a-z0-9]+", r"\.[a-f0-9]{8,}", r"^\.", r"test[/]fixtures", r"__fixtures__", r"\.generated\.", r"\.extr$", r"\.tmp$", r"\.temp$", r"dist[/]", r"build[/]", r"\.next[/]", r"node_modules[/]"]
STOP_WORDS = """a an and are as at be but by do does for from has have how i if in into is it its of on or that the to was were what when where
which who why will with work works about this""".split()  # fixed values: stop words
# Verb phrases by the first word of a name.
VERBS = {
    "get": "Returns", "fetch": "Fetches", "load": "Loads", "read": "Reads", "set": "Sets", "save": "Saves", "store": "Stores",
    "write": "Writes", "create": "Creates", "make": "Creates", "build": "Builds", "generate": "Generates", "update": "Updates",
    "modify": "Modifies", "patch": "Patches", "delete": "Deletes", "remove": "Removes", "destroy": "Destroys", "parse": "Parses",
    "format": "Formats", "serialize": "Serializes", "stringify": "Serializes", "validate": "Validates", "check": "Checks",
    "verify": "Verifies", "is": "Returns whether", "has": "Returns whether", "should": "Returns whether", "render": "Renders", "draw": "Renders",
    "handle": "Handles", "on": "Handles", "use": "React hook for", "init": "Initializes", "setup": "Sets up", "configure": "Configures",
    "compute": "Computes", "calculate": "Calculates", "count": "Counts", "filter": "Filters", "map": "Maps", "reduce": "Reduces",
    "sort": "Sorts", "find": "Finds", "search": "Searches", "match": "Matches", "send": "Sends", "emit": "Emits",
    "dispatch": "Dispatches", "start": "Starts", "stop": "Stops", "open": "Opens", "close": "Closes", "connect": "Connects",
    "disconnect": "Disconnects", "resolve": "Resolves", "reject": "Rejects", "authenticate": "Authenticates", "to": "Converts to",
    "from": "Builds from", "with": "Wraps with", "ensure": "Ensures", "apply": "Applies", "run": "Runs", "execute": "Executes",
    "process": "Processes", "transform": "Transforms", "normalize": "Normalizes", "sanitize": "Sanitizes", "hash": "Hashes",
    "encrypt": "Encrypts", "decrypt": "Decrypts",
}
# Behaviour tags by patterns of the content; \b is an edge of ASCII words.
TAG_PATTERNS = {
    "api-client": [r"\bfetch\s*\(", r"\baxios\b", r"\bgot\b", r"\bnode-fetch\b", r"\bundici\b", r"\buseQuery\s*\(", r"\buseMutation\s*\(", r"\buseSWR\s*\(", r"\bApolloClient\b", r"\bgraphql\s*\("],
    "browser-storage": [r"\blocalStorage\b", r"\bsessionStorage\b", r"\bdocument\.cookie\b", r"\bcookies\.set\b", r"\bIndexedDB\b"],
    "side-effect-hook": [r"\buseEffect\s*\(", r"\buseLayoutEffect\s*\(", r"\buseInsertionEffect\s*\("],
    "db-client": [r"\bmongoose\b", r"\bprisma\b", r"\b@prisma/client\b", r"\bpg\b", r"\bmysql2\b", r"\bsequelize\b", r"\bdrizzle-orm\b", r"\bkysely\b", r"\bsupabase\b", r"\bfirebase\b"],
    "auth": [r"\bnext-auth\b", r"\b@auth/", r"\bpassport\b", r"\bjsonwebtoken\b", r"\bjwt\b", r"\bbcrypt\b", r"\bargon2\b", r"\bcrypto\b", r"\bsession\b"],
    "routing": [r"\breact-router\b", r"\bvue-router\b", r"\b@tanstack/react-router\b", r"\buseRouter\b", r"\buseSearchParams\b", r"\buseParams\b", r"\bLink\s+from\s+['\"]next/link['\"]", r"\busePathname\s*\("],
}
# Behaviour tags by imported package.
IMPORT_TAGS = {
    "api-client": ["axios", "node-fetch", "undici", "@tanstack/react-query", "@apollo/client", "graphql-request"],
    "db-client": ["mongoose", "@prisma/client", "pg", "mysql2", "sequelize", "drizzle-orm", "kysely", "@supabase/supabase-js", "firebase"],
    "auth": ["next-auth", "@auth/core", "passport", "jsonwebtoken", "bcrypt", "argon2"],
    "routing": ["react-router-dom", "vue-router", "@tanstack/react-router"],
}
# Roles of user interface files, in order.
UI_ROLES = [("navbar|nav", "navigation bar"), ("footer", "footer section"), ("header", "header section"), ("dashboard", "dashboard screen"), ("auth|login|signup|signin", "authentication flow"),
            ("contact", "contact page"), ("about", "about page"), ("team", "team page"), ("policy|terms|privacy", "policy/legal page"), ("modal|dialog", "modal dialog"), ("form", "form-driven UI"), ("card", "card-based UI section")]
# Behaviour signals in order: text they look at (s snippet, l snippet in lower case, n path and names, b both), pattern, sentence.
SIGNALS = [
    ("s", "useState|useReducer", "manages local component state"),
    ("s", "useEffect|useLayoutEffect", "runs side effects in response to lifecycle or state changes"),
    ("s", "useContext", "consumes shared React context"),
    ("r", "useNavigate|useLocation|useParams|useSearchParams|<Route|createBrowserRouter", "integrates with client-side routing"),
    ("l", r"fetch\(|axios|api\.|client\.", "talks to external APIs or data clients"),
    ("b", "search", "implements search or query-driven filtering"),
    ("l", "form|onsubmit|handlesubmit|input|textarea|select", "handles form input and submission flows"),
    ("b", "auth|login|logout|signup|signin|token|password|currentuser|isloggedin", "contains authentication-related logic or UI states"),
    ("b", "notif|toast|alert|bell", "surfaces notifications or alerts"),
    ("b", "avatar|profile|pfp|user image", "renders user identity or profile visuals"),
    ("l", "mobile|menuopen|ismen|drawer|hamburger", "includes responsive navigation or mobile menu behavior"),
    ("b", "chart|graph|analytics|metric|stats", "presents analytics or metric-driven content"),
    ("b", "canvas|drag|drop|builder|editor", "supports builder-style or interactive canvas behavior"),
    ("b", "audio|voice|sound|wave", "renders audio or voice-related interaction states"),
]


# Display names of languages.
LANG_DISPLAY = {
    "javascript": "JavaScript", "javascriptreact": "JavaScript (JSX)", "typescript": "TypeScript", "typescriptreact": "TypeScript (TSX)", "json": "JSON", "yaml": "YAML", "toml": "TOML", "css": "CSS",
    "scss": "SCSS", "sass": "Sass", "less": "Less", "markdown": "Markdown", "html": "HTML", "text": "plain-text", "sql": "SQL", "dotenv": "dotenv", "svg": "SVG",
}
# Node colours of the viewer.
COLORS = {"code": "#be5985", "package": "#2ca02c", "config": "#9467bd", "docs": "#d97706", "media": "#d97706", "style": "#9467bd", "database": "#9467bd", "other": "#be5985", "isolated": "#a89098"}
