"""Scalar text functions of retrieval, as Column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# These lists and patterns decide results and are given by the data contract.
STOPWORDS = [
    "a", "an", "and", "are", "as", "at", "be", "by", "did", "do", "does", "for", "from", "how", "in", "into", "is", "it", "its",
    "of", "on", "or", "that", "the", "this", "to", "was", "were", "what", "when", "where", "which", "who", "why", "with",
    "nedir", "nasil", "nasıl", "neler", "nelerdir", "neden", "hangi", "kac", "kaç", "icin", "için", "ile", "ve", "bir", "bu", "su", "şu", "ne",
]
GREETINGS = [
    "merhaba", "selam", "hello", "hi", "hey", "nasılsın", "nasilsin", "how are you", "iyiyim", "teşekkür", "tesekkur", "thanks", "thank you",
    "günaydın", "gunaydin", "iyi günler", "iyi gunler", "iyi akşamlar", "iyi aksamlar", "iyi geceler", "mrb", "sa", "as", "naber",
]
SOCIAL_ONLY = ["nasıl", "nasil", "nerede", "kim", "ne", "what", "who", "where"]
IDENTIFIERS = [
    r"(?<![A-Za-z0-9_])[A-Za-z_]\w*(?:\.[A-Za-z_]\w*)+(?![A-Za-z0-9_])",
    r"\b[A-Z][A-Z0-9]*(?:_[A-Z0-9]+)+\b",
    r"\b[A-Z][a-z0-9]+(?:[A-Z][a-z0-9]*){1,}\b",
    r"\b[a-z][a-z0-9]*(?:_[a-z0-9]+)+\b",
    r"\b[A-Z][A-Z0-9]*\d+[A-Z0-9]*\b",
    r"\b[A-Za-z_]\w*(?:Error|Exception)\b",
    r"\b[a-z_][a-zA-Z0-9]*(?=\()",
]
PEM = r"(?s)-----BEGIN (?:RSA |EC |DSA |OPENSSH |PGP |ENCRYPTED )?PRIVATE KEY-----.*?-----END (?:RSA |EC |DSA |OPENSSH |PGP |ENCRYPTED )?PRIVATE KEY-----"
TOKEN = r"(?i)\b(sk-[A-Za-z0-9_\-]{8,}|ghp_[A-Za-z0-9]{20,}|AKIA[0-9A-Z]{16}|xox[baprs]-[A-Za-z0-9\-]{10,}|eyJ[A-Za-z0-9_\-]{10,}\.[A-Za-z0-9_\-]{10,}\.[A-Za-z0-9_\-]{10,})\b"
KEY_VALUE = (
    r"(?i)(\b(?:api[_-]?key|apikey|secret|secret[_-]?key|password|passwd|pwd|token|access[_-]?token|access[_-]?key|auth|credential"
    r"|private[_-]?key|client[_-]?secret|db_password|connection[_-]?string)\b\s*[:=]\s*)([\"']?[^\s\"',;]+[\"']?)"
)
# The names of the rules and what each finds, in any case.
INJECTIONS = {
    "system_role_override": r"<\|im_start\|>system",
    "system_role_override2": r"<\|system\|>",
    "system_role_override3": r"<\|endoftext\|>",
    "pretend_system": r"you\s+are\s+now\s+(?:the\s+)?system",
    "act_as_system": r"role\s*[:=]\s*system",
    "new_system_prompt": r"set(?:ting)?\s+your\s+system\s+prompt",
    "ignore_prior": r"ignore\s+(?:all\s+)?(?:the\s+|my\s+|your\s+)?(?:previous|prior|above)\s+instructions",
    "ignore_earlier": r"disregard\s+(?:all\s+)?(?:previous|prior|above)\s+(?:instructions|guidelines)",
    "forget_context": r"forget\s+(?:everything|all\s+(?:previous|prior)\s+(?:context|instructions))",
    "reveal_system_prompt": r"(?:reveal|show|print|expose|repeat|leak)\s+(?:your\s+|the\s+)?system\s+prompt",
    "reveal_cot": r"(?:show|reveal|explain|output)\s+(?:your|the)\s+(?:chain\s+of\s+thought|reasoning\s+process|inner\s+monologue)",
    "extract_instructions": r"what\s+are\s+your\s+internal\s+instructions",
    "jailbreak_dan": r"\bdan\b(?:\s+mode)?:?\s+(?:do\s+anything\s+now|jailbreak)",
    "developer_mode": r"(?:developer|dev)\s+mode",
    "no_restrictions": r"ignore\s+(?:your\s+)?(?:safety|content)\s+(?:policy|filters|guidelines|restrictions)",
    "pretend_no_limits": r"pretend\s+you\s+(?:have|are\s+running\s+with)\s+no\s+restrictions",
}
# The language of an extension and of a file name, in the order of the data contract.
EXTENSIONS = {
    "py": "python", "pyi": "python", "pyw": "python", "java": "java", "kt": "kotlin", "kts": "kotlin", "scala": "scala", "sc": "scala", "go": "go",
    "rs": "rust", "c": "c", "h": "c", "cc": "cpp", "cpp": "cpp", "cxx": "cpp", "c++": "cpp", "hh": "cpp", "hpp": "cpp", "hxx": "cpp", "cs": "csharp",
    "js": "javascript", "mjs": "javascript", "cjs": "javascript", "jsx": "javascript", "ts": "typescript", "mts": "typescript", "cts": "typescript",
    "tsx": "typescript", "rb": "ruby", "rake": "ruby", "php": "php", "swift": "swift", "m": "objective-c", "mm": "objective-c", "sh": "shell",
    "bash": "shell", "zsh": "shell", "fish": "shell", "ps1": "powershell", "bat": "batch", "cmd": "batch", "sql": "sql", "plsql": "plsql",
    "pkb": "plsql", "pks": "plsql", "prc": "plsql", "fnc": "plsql", "trg": "plsql", "vw": "plsql", "json": "json", "yaml": "yaml", "yml": "yaml",
    "toml": "toml", "xml": "xml", "html": "html", "htm": "html", "css": "css", "scss": "scss", "sass": "scss", "less": "less", "md": "markdown",
    "markdown": "markdown", "mdx": "markdown", "rst": "markdown", "txt": "plaintext", "text": "plaintext", "ipynb": "jupyter",
    "dockerfile": "dockerfile", "makefile": "makefile", "tf": "terraform", "hcl": "hcl", "proto": "protobuf", "graphql": "graphql", "gql": "graphql",
    "r": "r", "lua": "lua", "ex": "elixir", "exs": "elixir", "erl": "erlang", "hrl": "erlang", "hs": "haskell", "clj": "clojure", "cljs": "clojure",
    "dart": "dart", "vue": "vue", "svelte": "svelte",
}
FILE_NAMES = {
    "dockerfile": "dockerfile", "makefile": "makefile", "cmakelists.txt": "cmake", "gemfile": "ruby", "rakefile": "ruby", "vagrantfile": "ruby",
    "procfile": "shell", "jenkinsfile": "groovy",
}
# Names and folders of generated files.
LOCKS = [
    "package-lock.json", "npm-shrinkwrap.json", "yarn.lock", "pnpm-lock.yaml", "poetry.lock", "requirements.txt.lock", "Pipfile.lock",
    "composer.lock", "Gemfile.lock", "go.sum", "Cargo.lock", "Pip.lock", "flake.lock",
]
GENERATED = ["__pycache__", ".pytest_cache", ".mypy_cache", ".ruff_cache", "target", "dist", "build"]
MASK = "[REDACTED]"
LEXEME = r"[\p{L}\p{N}_]+"


def strings(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def normalize_query(text: Column) -> Column:
    plain = F.regexp_replace(F.lower(text), "[‘’“”]", "'")
    return F.trim(F.regexp_replace(F.regexp_replace(plain, r"(?U)[^\w\s]", " "), r"(?U)\s+", " "))


def is_smalltalk(text: Column, least: int = 20) -> Column:
    """Empty, or a greeting stands in it and it is no informative question."""
    plain = normalize_query(text)
    greeted = F.exists(strings(GREETINGS), lambda k: F.contains(plain, k))
    tokens = F.filter(F.split(plain, " "), lambda t: F.length(t) > 1)
    informative = (F.length(plain) >= least) & (F.size(F.array_except(tokens, strings(SOCIAL_ONLY))) > 0)
    return (plain == "") | (greeted & ~informative)


def lexemes(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(LEXEME), F.lit(0))


def query_terms(text: Column) -> Column:
    """Lexemes over one character that are no stop words; all lexemes if none is left."""
    every = lexemes(text)
    kept = F.filter(every, lambda t: (F.length(t) > 1) & ~F.array_contains(strings(STOPWORDS), t))
    return F.array_distinct(F.when(F.size(kept) > 0, kept).otherwise(every))


def significant_terms(text: Column) -> Column:
    """Lexemes over one character that are no stop words, each once, then joined neighbours that are all letters."""
    kept = F.filter(lexemes(text), lambda t: (F.length(t) > 1) & ~F.array_contains(strings(STOPWORDS), t))
    letters = lambda t: t.rlike(r"^\p{L}+$")
    pairs = F.transform(kept, lambda t, i: F.when(letters(t) & letters(F.get(kept, i + 1)), F.concat(t, F.get(kept, i + 1))))
    return F.array_distinct(F.concat(kept, F.array_compact(pairs)))


def has_any_term(text: Column, terms: Column) -> Column:
    """Whether a term stands anywhere in the text, in any case, inside words too."""
    lowered = F.lower(F.coalesce(text, F.lit("")))
    return F.exists(terms, lambda t: F.contains(lowered, F.lower(t)))


def identifiers(text: Column, patterns: list[str] = IDENTIFIERS) -> Column:
    """Identifier-like tokens, by pattern and then by place, each once."""
    found = [F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(p), F.lit(0)) for p in patterns]
    return F.array_distinct(F.filter(F.concat(*found), lambda t: F.length(t) >= 2))


def index_identifiers(text: Column) -> Column:
    """What an index holds of a chunk: its identifiers, null without any."""
    found = identifiers(text)
    return F.when(F.size(found) > 0, found)


def heading(path: Column) -> Column:
    return F.array_join(F.filter(path, lambda h: F.coalesce(h, F.lit("")) != ""), " > ")


def embedding_text(path: Column, content: Column) -> Column:
    """The content under a line with its headings; the content alone without any."""
    return F.when(heading(path) != "", F.concat(F.lit("# "), heading(path), F.lit("\n\n"), content)).otherwise(content)


def flat_table(cells: Column) -> Column:
    """Rows of cells as plain text, a line for each row."""
    return F.array_join(F.transform(cells, lambda row: F.array_join(row, " ", "")), "\n")


def markdown_table(cells: Column) -> Column:
    """Rows of cells as a pipe table; the first row is the header, and pipes in cells are escaped."""
    line = lambda row: F.concat(F.lit("| "), F.array_join(F.transform(row, lambda c: F.replace(F.replace(F.coalesce(c, F.lit("")), F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" "))), " | "), F.lit(" |"))
    rule = F.concat(F.lit("|"), F.repeat(F.lit(" --- |"), F.size(F.get(cells, F.lit(0)))))
    rows = F.transform(cells, line)
    return F.when(F.size(cells) > 0, F.array_join(F.concat(F.slice(rows, 1, 1), F.array(rule), F.slice(rows, F.lit(2), F.greatest(F.size(rows) - 1, F.lit(0)))), "\n"))


def _looked_up(key: Column, pairs: dict[str, str]) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in pairs.items() for x in pair]), key)


def file_name(path: Column) -> Column:
    return F.element_at(F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/"), -1)


def language(path: Column) -> Column:
    """The language of a path: by its file name, then by its extension; null where neither is known."""
    name = F.lower(file_name(path))
    return F.coalesce(_looked_up(name, FILE_NAMES), F.when(F.contains(name, F.lit(".")), _looked_up(F.substring_index(name, ".", -1), EXTENSIONS)))


def is_generated(path: Column) -> Column:
    """Lock files, minified files, and what lies in a folder of build output."""
    name, parts = F.lower(file_name(path)), F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/")
    return name.rlike("[.](?:lock|lockb|min[.]js|min[.]css)$") | name.isin(LOCKS) | F.arrays_overlap(parts, strings(GENERATED))


def log_field(text: Column, most: int = 1024) -> Column:
    """A value for a log: masked whole if it holds a secret, else cut."""
    return F.when(contains_secret(text), F.lit(MASK)).when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit("..."))).otherwise(text)


def naive_tokens(text: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(F.length(text) / 4).cast("int"))


def conservative_tokens(text: Column) -> Column:
    other = F.length(F.regexp_replace(text, "[\\x00-\\x7F]", ""))
    return F.when(F.length(text) == 0, 0).otherwise(F.greatest(F.ceil(F.length(text) / 3).cast("int"), other, F.lit(1)))


def redact(text: Column) -> Column:
    out = F.regexp_replace(text, PEM, MASK)
    out = F.regexp_replace(out, TOKEN, MASK)
    return F.regexp_replace(out, KEY_VALUE, "$1" + MASK)


def contains_secret(text: Column) -> Column:
    return text.rlike(PEM) | text.rlike(TOKEN) | text.rlike(KEY_VALUE)


def injections(text: Column) -> Column:
    """Names of the rules that match, in their order."""
    return F.array_compact(F.array(*[F.when(text.rlike("(?i)" + p), F.lit(name)) for name, p in INJECTIONS.items()]))


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)
