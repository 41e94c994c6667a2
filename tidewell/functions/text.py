"""Text functions on columns, all built from Spark's own."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: White space that both ends of a text lose.
BLANK = r"[\s ]"


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def fold_ascii(x: Column | str) -> Column:
    """A-Z to a-z; other letters keep their case."""
    return F.translate(col(x), UPPER, LOWER)


def strip(x: Column | str) -> Column:
    """Without white space at either end."""
    return F.regexp_replace(col(x), rf"^{BLANK}+|{BLANK}+$", "")


def split_words(x: Column | str) -> Column:
    """White-space separated words, none empty."""
    return F.filter(F.split(col(x), r"\s+"), lambda w: w != "")


def contains_all_literal(haystack: Column, needle: str) -> Column:
    return F.contains(haystack, F.lit(needle))


def fold_ascii_text(s: str) -> str:
    """A-Z to a-z, all else as it is."""
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)


def like_ascii(x: Column | str, pattern: str) -> Column:
    """Substring match with live ``%`` and ``_`` that folds ASCII case only.

    Spark's escape character is set to NUL, so a backslash is itself.
    """
    folded = pattern.translate(str.maketrans(UPPER, LOWER))
    return fold_ascii(x).like("%" + folded.replace("\\", "\\\\") + "%")


def extract_title(text: Column | str, name: Column | str) -> Column:
    """First line that isn't blank: what follows ``# ``, or the line without
    closing ``#``; the file's stem where there is none."""
    lines = F.filter(F.transform(F.split(col(text), r"\r?\n"), strip), lambda x: x != "")
    first = F.try_element_at(lines, F.lit(1))
    return F.when(first.isNull(), file_stem(name)).when(first.startswith("# "), strip(F.substring(first, 3, 1 << 30))).otherwise(
        strip(F.regexp_replace(first, "#+$", ""))
    )


def file_stem(name: Column | str) -> Column:
    """Last path segment without its extension; a leading dot starts no extension."""
    base = F.regexp_extract(col(name), r"([^/]*)/*$", 1)
    return F.when(base.rlike(r"^.+\.[^.]*$"), F.regexp_extract(base, r"^(.+)\.[^.]*$", 1)).otherwise(base)


def doc_extension(name: Column | str) -> Column:
    """Lower-case extension with its dot, or ''."""
    return F.regexp_extract(F.lower(col(name)), r"(\.[^.]*)$", 1)


def bare_extension(kind: Column | str) -> Column:
    """A file type as callers write it: trimmed, no leading dots, lower case; null if empty."""
    return F.nullif(F.lower(F.regexp_replace(strip(kind), r"^\.+", "")), F.lit(""))


def sanitize_file_name(name: Column | str) -> Column:
    """One safe path segment: unsafe characters become ``-``, leading dots go."""
    safe = F.regexp_replace(strip(name), r'[/\\\x00:*?"<>|]', "-")
    return strip(F.regexp_replace(safe, r"^\.+", ""))


def with_extension(name: Column | str, kind: Column | str) -> Column:
    """The name ending in ``.kind``, appended unless there in any case."""
    n, k = col(name), F.regexp_replace(strip(kind), r"^\.+", "")
    dotted = F.concat(F.lit("."), k)
    return F.when(F.endswith(F.lower(n), F.lower(dotted)), n).otherwise(F.concat(n, dotted))


def slugify(name: Column | str) -> Column:
    """ASCII letters and digits in lower case, anything else one ``-`` between them."""
    return F.regexp_replace(F.regexp_replace(fold_ascii(name), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def bracket_prefix(message: Column | str) -> Column:
    """What stands in brackets at the start, null if nothing does."""
    return F.nullif(F.regexp_extract(col(message), r"^\[([^\]]+)\]", 1), F.lit(""))


def level_prefix(message: Column | str) -> tuple[Column, Column]:
    """Level and message of a line like ``[WARN] text``; other lines are info."""
    m = strip(message)
    tag = F.regexp_extract(m, r"^\[(ERROR|WARN|INFO|DEBUG)\]", 1)
    return F.when(tag == "", F.lit("info")).otherwise(F.lower(tag)), F.when(tag == "", m).otherwise(
        strip(F.regexp_replace(m, r"^\[(ERROR|WARN|INFO|DEBUG)\]", ""))
    )


def log_line(at: Column, level: Column, server: Column, message: Column) -> Column:
    """``[time] [level] [server] message``; no server, no third bracket."""
    who = F.when(server.isNull(), F.lit("")).otherwise(F.concat(F.lit("["), server, F.lit("] ")))
    return F.concat(F.lit("["), F.date_format(at, "yyyy-MM-dd HH:mm:ss"), F.lit("] ["), level, F.lit("] "), who, message)


def render_template(template: Column | str, args: dict[str, Column]) -> Column:
    """``{{name}}`` by its value, one name after the other, so values may hold names."""
    return reduce(lambda t, kv: F.replace(t, F.lit("{{" + kv[0] + "}}"), kv[1].cast("string")), args.items(), col(template))


def detect_variables(payload: Column | str) -> Column:
    """Names in ``${...}``, each once, in order of appearance."""
    return F.array_distinct(F.regexp_extract_all(col(payload), F.lit(r"\$\{([^}]+)\}"), F.lit(1)))


def normalize_package(raw: Column | str) -> Column:
    """Package name without extras, version and specifiers; a scope stays."""
    r = F.regexp_replace(col(raw), r"\[.*$", "")
    r = F.when(r.startswith("@"), F.regexp_replace(r, r"^(@[^@]*)@.*$", "$1")).otherwise(F.regexp_replace(r, "@.*$", ""))
    return strip(F.regexp_replace(r, "[=><~;].*$", ""))


def package_of_command(command: Column | str, args: Column | str) -> Column:
    """Package that a runner starts: ``npx`` takes what follows ``--`` or the first
    argument that is no flag; ``uvx`` prefers ``--from``, the last of several. Null for other runners."""
    c, a = col(command), col(args)
    bare = F.filter(a, lambda x: ~x.startswith("-"))
    dash = F.array_position(a, "--")
    plain_at = F.array_position(F.transform(a, lambda x: ~x.startswith("-")), F.lit(True))
    npx = F.when((dash > 0) & ((plain_at == 0) | (dash < plain_at)), F.try_element_at(a, (dash + 1).cast("int"))).otherwise(F.try_element_at(bare, F.lit(1)))

    def state(takes, named, free) -> Column:
        return F.struct(takes.alias("takes"), named.alias("named"), free.alias("free"))

    def step(s: Column, x: Column) -> Column:
        no = F.lit(False)
        return (
            F.when(s["takes"], state(no, x, s["free"])).when(x == "--from", state(F.lit(True), s["named"], s["free"]))
            .when(x.startswith("--from="), state(no, F.substring(x, 8, 1 << 30), s["free"])).when(x.startswith("-"), s)
            .otherwise(state(no, s["named"], F.coalesce(s["free"], x)))
        )

    none = F.lit(None).cast("string")
    read = F.aggregate(a, state(F.lit(False), none, none), step)
    return normalize_package(F.when(c == "npx", npx).when(c == "uvx", F.coalesce(read["named"], read["free"])))


#: Largest number that counts as one.
MOST = 2**64 - 1


def whole_number(x: Column) -> Column:
    """Digits as a decimal, null where they make a number over ``MOST``."""
    n = F.ltrim(x, F.lit("0"))
    n = F.when(F.length(n) <= 20, F.when(n == "", "0").otherwise(n).try_cast("decimal(21,0)"))
    return F.when(n <= F.lit(str(MOST)).cast("decimal(21,0)"), n)


def progress_pct(line: Column | str) -> Column:
    """First ``N%`` or ``a/b`` of a line as 0 to 100, null without one.

    A number that is too long ends the search, so a line with one before or in
    the first match has none.
    """
    t = col(line)
    found = r"^(?s)(.*?\d+) *(%|/ *0*[1-9]\d*)"
    before, after = F.regexp_extract(t, found, 1), F.regexp_extract(t, found, 2)
    num = whole_number(F.regexp_extract(before, r"(\d+)$", 1))
    total = whole_number(F.regexp_extract(after, r"(\d+)$", 1))
    short = ~F.exists(F.regexp_extract_all(before, F.lit(r"\d+"), F.lit(0)), lambda x: whole_number(x).isNull())
    # Below the total, a hundred times the number is divided without a rest, so nothing rounds up.
    part = F.when(num >= total, 100).otherwise(F.floor((num * 100 - F.pmod(num * 100, total)) / total))
    pct = F.when(after == "%", F.least(num, F.lit(100).cast("decimal(21,0)")).cast("int")).when(total.isNotNull(), part.cast("int"))
    return F.when((after != "") & short, pct)


def looks_like_download(line: Column | str) -> Column:
    """Whether a line of a package runner speaks of a download."""
    low = fold_ascii(line)
    return F.contains(low, F.lit("download")) | (low.rlike("added|installed") & F.contains(low, F.lit("package"))) | progress_pct(line).isNotNull()


def body_limit(x: Column | str, default: int = 1 << 20) -> Column:
    """Bytes of ``1mb``, ``512kb``, ``10b`` or ``123``; the default for anything else, numbers that are too long among it."""
    t = F.lower(strip(x))
    n = F.regexp_extract(t, r"^\+?(\d+)\s*(?:mb|kb|b)?$", 1).try_cast("bigint")
    n = F.when(t.rlike(r"^\+?\d+$") | t.rlike(r"^\+?\d+\s*(mb|kb|b)$"), n)
    unit = F.when(F.endswith(t, F.lit("mb")), 1 << 20).when(F.endswith(t, F.lit("kb")), 1 << 10).otherwise(1)
    return F.coalesce(F.try_multiply(n, unit.cast("bigint")), F.lit(default)).cast("bigint")


def format_size(n: Column | str) -> Column:
    """Bytes as ``B``, ``KB``, ``MB`` or ``GB`` with two decimals above, ties to even."""
    b = col(n).cast("bigint")

    def shown(unit: int, name: str) -> Column:
        q, r = F.floor(b * 100 / F.lit(unit)).cast("bigint"), (b * 100) % unit * 2
        up = (r > unit) | ((r == unit) & (q % 2 == 1))
        return F.format_string(f"%d.%02d {name}", *(f(q + up.cast("bigint")) for f in (lambda x: F.floor(x / 100).cast("bigint"), lambda x: x % 100)))

    return F.when(b >= 1 << 30, shown(1 << 30, "GB")).when(b >= 1 << 20, shown(1 << 20, "MB")).when(b >= 1 << 10, shown(1 << 10, "KB")).otherwise(
        F.concat(b.cast("bigint").cast("string"), F.lit(" B"))
    )


def format_duration(ms: Column | str) -> Column:
    """Milliseconds as ``ms``, ``s`` or ``m``, halves up; a dash for null."""
    t = col(ms)
    return (
        F.when(t.isNull(), F.lit("—")).when(t < 1000, F.concat(t.cast("bigint").cast("string"), F.lit("ms")))
        .when(t < 60000, F.format_string("%.2fs", t / F.lit(1000.0))).otherwise(F.format_string("%.2fm", t / F.lit(60000.0)))
    )


def format_tokens(n: Column | str) -> Column:
    """``950`` or ``4.2k``, halves up."""
    t = col(n)
    return F.when(t < 1000, t.cast("bigint").cast("string")).otherwise(F.format_string("%.1fk", t / F.lit(1000.0)))


def percent_saved(direct: Column | str, smart: Column | str) -> Column:
    """Whole percent less, halves rounded up, 0 to 100."""
    d, s = col(direct), col(smart)
    pct = F.floor((d - s) / F.nullif(d, F.lit(0)) * 100 + F.lit(0.5))
    return F.when(d <= 0, 0).otherwise(F.greatest(F.lit(0), F.least(F.lit(100), pct))).cast("int")


def client_ip(forwarded: Column | str, real: Column | str, fallback: Column | str) -> Column:
    """First address of the forwarding headers, else the peer's, else the local one."""
    return F.coalesce(strip(F.split_part(F.coalesce(col(forwarded), col(real)), F.lit(","), F.lit(1))), col(fallback), F.lit("127.0.0.1"))


def server_kind(kind: Column | str, url: Column | str, command: Column | str) -> Column:
    """Transport that an imported entry means, whatever its spelling."""
    n = F.translate(F.lower(strip(F.coalesce(col(kind), F.lit("stdio")))), "_ ", "--")
    found = (
        F.when(n == "sse", "sse").when(n.isin("streamable-http", "streamablehttp", "streamable"), "streamable-http").when(n.isin("openapi", "open-api"), "openapi")
        .when(n == "stdio", "stdio").when(F.contains(n, F.lit("sse")), "sse").when(n.rlike("http|stream"), "streamable-http")
        .when(n.rlike("openapi|open-api"), "openapi").otherwise("stdio")
    )
    return F.when((found == "stdio") & col(url).isNotNull() & col(command).isNull(), "sse").otherwise(found)


def clean_tags(tags: Column | str) -> Column:
    """Trimmed tags without the empty ones, in order."""
    return F.filter(F.transform(col(tags), strip), lambda t: t != "")


def redact_env(env: Column | str, marker: str = "***") -> Column:
    """Values of a map whose key speaks of a secret, replaced."""
    return F.transform_values(col(env), lambda k, v: F.when(F.lower(k).rlike("key|token|secret|password|auth"), F.lit(marker)).otherwise(v))


def parse_json_or_null(x: Column | str) -> Column:
    """A variant, null where the text is no JSON or goes on after it.

    The parser stops at the end of the first value, so the text must also be
    the only element of an array.
    """
    alone = F.json_array_length(F.concat(F.lit("["), col(x), F.lit("]"))) == 1
    return F.when(alone, F.try_parse_json(col(x)))


#: Syntax names that differ from the extension.
SYNTAX = {
    ".bash": "bash", ".c": "c", ".cc": "cpp", ".cjs": "javascript", ".cpp": "cpp", ".cs": "csharp", ".css": "css", ".go": "go", ".h": "c", ".hpp": "cpp",
    ".htm": "xml", ".html": "xml", ".java": "java", ".js": "javascript", ".json": "json", ".jsx": "javascript", ".kt": "kotlin", ".lua": "lua", ".mjs": "javascript",
    ".php": "php", ".py": "python", ".r": "r", ".rb": "ruby", ".rs": "rust", ".scala": "scala", ".sh": "bash", ".sql": "sql", ".swift": "swift", ".toml": "ini",
    ".ts": "typescript", ".tsx": "typescript", ".xml": "xml", ".yaml": "yaml", ".yml": "yaml",
}
WHOLE_NAMES = {"dockerfile": "dockerfile", "makefile": "makefile"}
MARKDOWN = [".md", ".markdown", ".mdx"]


def syntax_of(name: Column | str) -> Column:
    """Highlighter of a file by its whole name, then its extension; null for markdown."""
    base, ext = F.lower(F.regexp_extract(col(name), r"([^/]*)$", 1)), doc_extension(name)
    pick = lambda table, key: F.create_map(*(F.lit(x) for kv in table.items() for x in kv))[key]
    return F.coalesce(pick(WHOLE_NAMES, base), F.when(ext.isin(MARKDOWN), F.lit(None)).otherwise(pick(SYNTAX, ext)))
