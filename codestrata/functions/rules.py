"""Rule tables.

Everything in this module is a fixed value: names, extensions, patterns and
messages that decide the results and must not be changed on their own.
"""

# --- languages -------------------------------------------------------------

LANGUAGE_BASIC = {
    ".go": "Go", ".js": "JavaScript", ".ts": "TypeScript", ".py": "Python",
    ".java": "Java", ".rb": "Ruby", ".php": "PHP", ".cs": "C#", ".c": "C",
    ".cpp": "C++", ".cc": "C++", ".h": "C/C++ Header", ".html": "HTML",
    ".htm": "HTML", ".css": "CSS", ".json": "JSON", ".xml": "XML",
    ".md": "Markdown", ".sh": "Shell", ".bat": "Batch", ".cmd": "Batch",
    ".sql": "SQL",
}
LANGUAGE_EXTENDED = {
    **LANGUAGE_BASIC,
    ".cxx": "C++", ".hpp": "C/C++ Header", ".rs": "Rust", ".kt": "Kotlin",
    ".swift": "Swift", ".scala": "Scala", ".r": "R", ".dart": "Dart",
    ".lua": "Lua", ".perl": "Perl", ".pl": "Perl", ".yaml": "YAML",
    ".yml": "YAML", ".toml": "TOML", ".ini": "INI", ".conf": "Configuration",
}
LANGUAGE_DEFAULT = "Plain Text"

# languages whose share of a repository is reported
SHARE_LANGUAGE = {
    ".go": "Go", ".js": "JavaScript", ".jsx": "JavaScript", ".ts": "TypeScript",
    ".tsx": "TypeScript", ".py": "Python", ".java": "Java", ".rb": "Ruby",
    ".php": "PHP", ".cs": "C#", ".c": "C/C++", ".cpp": "C/C++", ".cc": "C/C++",
    ".cxx": "C/C++", ".h": "C/C++", ".hpp": "C/C++", ".rs": "Rust",
    ".kt": "Kotlin", ".kts": "Kotlin", ".swift": "Swift", ".scala": "Scala",
    ".r": "R", ".dart": "Dart",
}
SHARE_MINIMUM = 0.01

# --- technologies, key files, issues ---------------------------------------

TECH_SUFFIX_BASIC = {
    ".go": "Go", ".js": "JavaScript", ".ts": "TypeScript", ".py": "Python",
    ".java": "Java", ".rb": "Ruby", ".php": "PHP", ".cs": "C#", ".c": "C/C++",
    ".cpp": "C/C++", ".h": "C/C++", ".html": "HTML", ".css": "CSS",
}
TECH_SUFFIX_EXTENDED = {
    **TECH_SUFFIX_BASIC,
    ".rs": "Rust", ".kt": "Kotlin", ".swift": "Swift", ".scala": "Scala",
    ".r": "R", ".R": "R", ".dart": "Dart", ".lua": "Lua", ".perl": "Perl",
    ".pl": "Perl",
}
TECH_BASENAME_BASIC = {
    "package.json": "Node.js", "go.mod": "Go", "requirements.txt": "Python",
    "Gemfile": "Ruby", "composer.json": "PHP",
}
TECH_BASENAME_EXTENDED = {
    **TECH_BASENAME_BASIC,
    "Cargo.toml": "Rust", "pom.xml": "Java", "build.gradle": "Gradle",
    "build.gradle.kts": "Gradle", "Makefile": "Make", "CMakeLists.txt": "CMake",
    "Dockerfile": "Docker", "docker-compose.yml": "Docker Compose",
    "docker-compose.yaml": "Docker Compose",
}
KEY_FILES_BASIC = [
    "main.go", "app.js", "index.js", "package.json", "go.mod",
    "requirements.txt", "setup.py", "Makefile", "Dockerfile",
    "docker-compose.yml", "README.md",
]
KEY_FILES_EXTENDED = KEY_FILES_BASIC + [
    "Cargo.toml", "pom.xml", "build.gradle", "CMakeLists.txt", "Gemfile",
    "composer.json", "pubspec.yaml", "Package.swift",
]
ISSUE_README = "Missing README file"
ISSUE_LICENSE = "Missing LICENSE file"
ISSUE_GITIGNORE = "Missing .gitignore file"
ISSUE_TESTS = "No test files found"

FRONTEND_PACKAGES = {
    "react": "React", "vue": "Vue.js", "@angular/core": "Angular",
    "svelte": "Svelte", "next": "Next.js", "nuxt": "Nuxt.js",
}
BACKEND_PACKAGES = {"express": "Express", "fastify": "Fastify", "koa": "Koa"}
BACKEND_PYTHON = {"django": "Django", "flask": "Flask", "fastapi": "FastAPI"}
BACKEND_GO = {
    "github.com/gin-gonic/gin": "Gin", "github.com/gofiber/fiber": "Fiber",
    "github.com/labstack/echo": "Echo",
}
BUILD_FILES = {
    "webpack.config.js": "Webpack", "webpack.config.ts": "Webpack",
    "vite.config.js": "Vite", "vite.config.ts": "Vite",
    "rollup.config.js": "Rollup", "rollup.config.ts": "Rollup",
    "esbuild.config.js": "esbuild", "tsconfig.json": "TypeScript Compiler",
    "babel.config.js": "Babel", ".babelrc": "Babel", "Makefile": "Make",
    "CMakeLists.txt": "CMake", "build.gradle": "Gradle",
    "build.gradle.kts": "Gradle", "pom.xml": "Maven", "Cargo.toml": "Cargo",
    "mix.exs": "Mix", "Rakefile": "Rake", "gulpfile.js": "Gulp",
    "Gruntfile.js": "Grunt", "turbo.json": "Turborepo", "nx.json": "Nx",
}
DATABASE_PATHS = {
    "prisma/schema.prisma": "Prisma", "drizzle.config.ts": "Drizzle ORM",
    "typeorm.config.js": "TypeORM", "sequelize.config.js": "Sequelize",
}
DATABASE_NPM = {
    "pg": "PostgreSQL", "mysql": "MySQL", "mysql2": "MySQL",
    "mongodb": "MongoDB", "mongoose": "MongoDB", "redis": "Redis",
    "sqlite3": "SQLite", "better-sqlite3": "SQLite",
}
DATABASE_PYTHON = {
    "psycopg2": "PostgreSQL", "pymongo": "MongoDB", "redis": "Redis",
    "mysql-connector": "MySQL", "sqlalchemy": "SQLAlchemy",
}
DATABASE_GO = {
    "lib/pq": "PostgreSQL", "go-sql-driver/mysql": "MySQL",
    "go-redis/redis": "Redis", "mongo-driver": "MongoDB", "gorm": "GORM",
}
TEST_NPM = {
    "jest": "Jest", "mocha": "Mocha", "jasmine": "Jasmine", "vitest": "Vitest",
    "cypress": "Cypress", "playwright": "Playwright",
    "@testing-library/react": "React Testing Library", "chai": "Chai",
}
TEST_PYTHON = {"pytest": "pytest", "unittest": "unittest", "nose": "nose"}
CICD_PATHS = {
    ".github/workflows": "GitHub Actions", ".gitlab-ci.yml": "GitLab CI",
    ".travis.yml": "Travis CI", "circle.yml": "CircleCI", ".circleci": "CircleCI",
    "Jenkinsfile": "Jenkins", "azure-pipelines.yml": "Azure Pipelines",
    ".drone.yml": "Drone CI", "bitbucket-pipelines.yml": "Bitbucket Pipelines",
}

# --- collection ------------------------------------------------------------

DEFAULT_EXCLUDES = [
    "node_modules/**", "vendor/**", ".git/**", "**/.git/**", ".svn/**",
    "**/.DS_Store", ".idea/**", ".vscode/**", "dist/**", "build/**",
    "**/__pycache__/**", "**/*.pyc", "**/*.pyo", "**/*.so", "**/*.dll",
    "**/*.exe", "**/*.bin", "**/*.obj", "**/*.o", "**/*.a", "**/*.lib",
]
BINARY_EXTENSIONS = [
    ".exe", ".dll", ".so", ".dylib", ".bin", ".obj", ".o", ".a", ".lib",
    ".pyc", ".pyo", ".pyd", ".class", ".jar", ".war", ".ear", ".png", ".jpg",
    ".jpeg", ".gif", ".bmp", ".ico", ".zip", ".tar", ".gz", ".rar", ".7z",
    ".pdf",
]
# media types known without any system table; source extensions are absent
MIME_BINARY = [
    ".avif", ".gif", ".jpeg", ".jpg", ".pdf", ".png", ".svg", ".wasm", ".webp",
]
MIME_TEXT = [".css", ".htm", ".html", ".js", ".mjs", ".xml"]

# Content signatures of the public MIME-sniffing rules that are not plain
# UTF-8 text, over the upper-case hex of the first 512 bytes.
SNIFF_BYTES = 512  # the rules look no further; a parameter of the detection
SNIFF_CONTROL = r"\A(?:..)*?(?:0[0-8BEF]|1[0-9A]|1[C-F])"
SNIFF_MARKUP_TAGS = [
    "!DOCTYPE HTML", "HTML", "HEAD", "SCRIPT", "IFRAME", "H1", "DIV", "FONT",
    "TABLE", "A", "STYLE", "TITLE", "B", "BODY", "BR", "P", "!--",
]
SNIFF_PREFIXES = [
    "%PDF-", "%!PS-Adobe-", "GIF87a", "GIF89a", "BM", "OTTO", "ttcf", "wOFF",
    "wOF2", "PK\x03\x04", "\x1f\x8b\x08", "\xfe\xff", "\xff\xfe", "\xff\xd8\xff",
    ".snd", "ID3",
]
SNIFF_FORM = ["AIFF"]
SNIFF_RIFF = ["WEBPVP", "AVI ", "WAVE"]

# --- line quality ----------------------------------------------------------

BLOCK_COMMENT_LANGUAGES = [
    "Go", "JavaScript", "TypeScript", "Java", "C", "C++", "C#", "Rust",
    "Kotlin", "Swift", "Scala",
]
HASH_COMMENT_LANGUAGES = ["Python", "Ruby", "Shell"]
MARKUP_COMMENT_LANGUAGES = ["HTML", "XML"]
COLON_NESTING_LANGUAGES = ["Python", "Ruby"]
COMPLEXITY_WORDS = [
    "if", "else", "for", "while", "switch", "case", "catch", "break",
    "continue", "return",
]
COMPLEXITY_SIGNS = [r"&&", r"\|\|", r"\?"]
DEBUG_MARKS = [
    "console.log", "console.error", "console.warn", "print(", "println(",
    "fmt.Println", "System.out.println", "debugger", "pdb.set_trace",
    "binding.pry",
]
SMELL_LONG = "Long line (>120 characters)"
SMELL_MULTI = "Multiple statements on one line"
SMELL_TODO = "TODO comment"
SMELL_FIXME = "FIXME comment"
SMELL_HACK = "HACK comment"
SMELL_DEBUG = "Debug/Console statement"
SMELL_MAGIC = "Magic number"
SMELL_DEEP = "Deeply nested code"
MAGIC_NUMBER = r"[^a-zA-Z0-9_]\d{2,}[^a-zA-Z0-9_]"
LONG_LINE_BYTES = 120
DEEP_INDENT = 32

# --- security --------------------------------------------------------------

_S = r"[\t\n\f\r ]"
_QS = r"['\"\t\n\f\r ]"
# name, severity, ignore case, pattern
SECRET_PATTERNS = [
    ("AWS Access Key", "critical", True,
     rf"(AWS|aws)(_|-)?ACCESS(_|-)?KEY(_|-)?ID{_QS}*[:=]{_S}*['\"]?[A-Z0-9]{{20}}['\"]?"),
    ("AWS Secret Key", "critical", True,
     rf"(AWS|aws)(_|-)?SECRET(_|-)?ACCESS(_|-)?KEY{_QS}*[:=]{_S}*['\"]?[A-Za-z0-9/+=]{{40}}['\"]?"),
    ("GitHub Token", "critical", True, r"gh[pousr]_[A-Za-z0-9_]{36,}"),
    ("Generic API Key", "critical", True,
     rf"api[_-]?key{_QS}*[:=]{_S}*['\"][A-Za-z0-9_\-]{{20,}}['\"]"),
    ("Private Key", "critical", False,
     rf"-----BEGIN{_S}+(RSA|DSA|EC|OPENSSH|PGP){_S}+PRIVATE{_S}+KEY-----"),
    ("Password in Code", "high", True,
     rf"(password|passwd|pwd){_QS}*[:=]{_S}*['\"][^'\"]{{8,}}['\"]"),
    ("JWT Token", "critical", False,
     r"eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
    ("Bearer Token", "critical", True, rf"bearer{_S}+[A-Za-z0-9_\-\.=]{{20,}}"),
    ("Slack Token", "critical", False, r"xox[baprs]-[0-9]{12}-[0-9]{12}-[A-Za-z0-9]{24}"),
    ("Stripe Key", "critical", True, r"(sk|pk)_(test|live)_[A-Za-z0-9]{24,}"),
    ("Database URL", "critical", True, r"(postgres|mysql|mongodb)://[^:]+:[^@]+@[^/]+"),
    ("OAuth Client Secret", "critical", True,
     rf"client[_-]?secret{_QS}*[:=]{_S}*['\"][A-Za-z0-9_\-]{{20,}}['\"]"),
    ("Secret in Code", "high", True,
     rf"secret{_QS}*[:=]{_S}*['\"][A-Za-z0-9_\-]{{16,}}['\"]"),
]
# every match of the patterns above contains one of these
SECRET_HINT = r"key|gh[pousr]_|passw|pwd|eyJ|bearer|xox|[sp]k_(?:test|live)|://|secret"
SECRET_SUGGESTION = "Move sensitive data to environment variables or secure vault"
SECRET_SKIP_DIRS = ["node_modules/", "vendor/", ".git/", "dist/", "build/", "target/"]
SECRET_SKIP_SUFFIXES = [
    ".png", ".jpg", ".jpeg", ".gif", ".svg", ".ico", ".woff", ".ttf", ".eot",
]
CONFIG_SUFFIXES = [".json", ".yaml", ".yml", ".toml", ".ini", ".conf", ".config"]
CONFIG_NAMES = [".env", ".npmrc", ".gitconfig"]
PRIVATE_KEY_MARKS = ["id_rsa", ".pem"]
# check name, file pattern (alternatives with "|", "*suffix" or substring)
CONFIG_CHECKS = [
    ("Docker Exposed Ports", "Dockerfile"),
    ("Nginx Security Headers", "nginx.conf"),
    ("CORS Configuration", "*.js|*.ts|*.go|*.py"),
]
NGINX_HEADERS = {
    "X-Frame-Options": "DENY or SAMEORIGIN",
    "X-Content-Type-Options": "nosniff",
    "X-XSS-Protection": "1; mode=block",
    "Strict-Transport-Security": "max-age=31536000",
}
CORS_HEADER = "Access-Control-Allow-Origin"
CORS_CREDENTIALS = ["credentials: true", "AllowCredentials"]
DANGEROUS_FILES = [
    (".env", "critical", "Environment file with potential secrets"),
    (".pem", "critical", "Private key file"),
    ("id_rsa", "critical", "SSH private key"),
    (".key", "critical", "Private key file"),
    ("credentials", "high", "File containing credentials"),
    ("secrets", "high", "File containing secrets"),
    (".htpasswd", "medium", "Password file"),
    ("database.yml", "medium", "Database configuration with potential credentials"),
]
DANGEROUS_SUGGESTION = "Ensure this file is in .gitignore and not committed"

# --- dependencies and advisories -------------------------------------------

NODE_SECTIONS = {
    "dependencies": "production", "devDependencies": "development",
    "optionalDependencies": "optional", "peerDependencies": "peer",
}
COMPOSER_SECTIONS = {"require": "production", "require-dev": "development"}
# package, version, severity, identifier, description, recommendation
ADVISORIES = [
    ("lodash", "4.17.15", "high", "CVE-2019-10744",
     "Prototype pollution vulnerability", "Update to lodash@4.17.21 or later"),
    ("axios", "0.21.0", "medium", "CVE-2020-28168",
     "SSRF vulnerability in axios", "Update to axios@0.21.1 or later"),
    ("express", "4.17.0", "medium", "CVE-2022-24999",
     "Open redirect vulnerability", "Update to express@4.17.3 or later"),
    ("django", "2.2.0", "high", "CVE-2021-35042",
     "SQL injection vulnerability", "Update to Django 2.2.24 or later"),
    ("flask", "0.12.0", "medium", "CVE-2018-1000656",
     "Denial of service vulnerability", "Update to Flask 1.0 or later"),
    ("requests", "2.19.0", "high", "CVE-2018-18074",
     "Credential exposure vulnerability", "Update to requests 2.20.0 or later"),
]
DEPRECATED = {
    "request": "Package deprecated, use axios or node-fetch instead",
    "gulp-util": "Package deprecated, use individual utilities",
    "node-uuid": "Use uuid package instead",
    "babel-preset-es2015": "Use @babel/preset-env instead",
    "babel-preset-stage-0": "Use explicit plugin list instead",
    "optparse": "Use argparse instead (built-in)",
    "imp": "Use importlib instead",
}
VERSION_PREFIXES = ["^", "~", ">=", "<=", ">", "<", "=", "v"]
PRERELEASE_MARKS = ["alpha", "beta", "rc", "pre", "preview", "canary", "next", "dev"]
SEVERITY_RANK = {"critical": 1, "high": 2, "medium": 3, "low": 4}
