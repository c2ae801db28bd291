"""Text functions from Column to Column: tokens, chunks, previews, redaction."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Languages by file extension.
LANGUAGES = {
    "rs": "rust", "ts": "typescript", "tsx": "typescript", "js": "javascript", "jsx": "javascript", "py": "python", "pyi": "python", "go": "go", "java": "java",
    "c": "c", "h": "c", "cpp": "cpp", "cc": "cpp", "cxx": "cpp", "hpp": "cpp", "rb": "ruby", "swift": "swift", "kt": "kotlin", "kts": "kotlin",
}
# Words that are no identifiers in a question.
STOP_WORDS = ("where", "what", "when", "how", "is", "the", "in", "to", "for", "and", "of", "a", "an")
# Redaction rules (category, pattern, placeholder), applied in order of the category's name.
REDACTION_RULES = (
    ("aws_access_key_id", r"\b(?:AKIA|ASIA)[0-9A-Z]{16}\b", "[REDACTED:aws_access_key]"),
    ("email_address", r"(?i)\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}\b", "[REDACTED:email]"),
    ("gcp_service_account", r'(?i)"type"\s*:\s*"service_account"', "[REDACTED:gcp_service_account]"),
    ("github_token", r"\bgh(?:p|o|u|s|r)_[A-Za-z0-9]{20,}\b", "[REDACTED:github_token]"),
    ("pem_private_key", r"(?s)-----BEGIN (?:RSA |EC |DSA |OPENSSH )?PRIVATE KEY-----.*?-----END (?:RSA |EC |DSA |OPENSSH )?PRIVATE KEY-----", "[REDACTED:private_key]"),
    ("slack_token", r"\bxox(?:b|p|a|r|s)-[A-Za-z0-9-]{10,48}\b", "[REDACTED:slack_token]"),
)
# Fixed value: characters that may stand in a token of high entropy, and the least length such a run has.
ENTROPY_TOKEN = r"[A-Za-z0-9+/=_-]{16,}"


def _words(text: Column, pattern: str) -> Column:
    return F.filter(F.split(text, pattern), lambda x: x != "")


def camel_tokens(text: Column) -> Column:
    """Split before every upper-case letter and at all that is no letter or digit; lower case."""
    parts = _words(F.regexp_replace(text, r"(?<=.)(?=\p{Lu})", " "), r"[^\p{L}\p{N}]+")
    return F.transform(parts, lambda x: F.lower(x))


def snake_tokens(text: Column) -> Column:
    return _words(F.lower(text), r"[^\p{L}\p{N}]+")


def dotted_tokens(text: Column) -> Column:
    return _words(F.lower(text), "[.:]")


def path_tokens(text: Column) -> Column:
    return _words(F.lower(text), r"[/\\.]")


def signature_tokens(text: Column) -> Column:
    """Camel tokens, then the snake tokens that aren't among them."""
    return F.array_distinct(F.concat(camel_tokens(text), snake_tokens(text)))


def rerank_tokens(text: Column) -> Column:
    """Distinct runs of letters, digits and underscores of two bytes or more."""
    return F.array_distinct(F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}_]+"), lambda x: F.octet_length(x) > 1))


def default_tokens(text: Column) -> Column:
    """Tokens of full-text columns: runs of letters and digits up to 40 bytes, lower case."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda x: (x != "") & (F.octet_length(x) <= 40))


def token_estimate(text: Column) -> Column:
    """1.3 tokens a word, rounded up."""
    return F.ceil(F.size(_words(F.coalesce(text, F.lit("")), r"\s+")) * F.lit(1.3)).cast("long")


def language_of(path: Column) -> Column:
    """Language of a file by its extension; null for other files, configuration and documents."""
    extension = F.regexp_extract(path, r"\.([^./\\]+)$", 1)
    table = F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair])
    return F.try_element_at(table, extension)


def lines(text: Column) -> Column:
    """Lines of a text, without an empty one after a last newline."""
    return F.split(F.regexp_replace(text, r"\n$", ""), "\n")


def content_head(text: Column, n: int = 20) -> Column:
    return F.array_join(F.slice(lines(text), 1, n), "\n")


def body_preview(text: Column, n: int = 10) -> Column:
    """The first n lines, and a mark if more follow."""
    all_lines = lines(text)
    head = F.array_join(F.slice(all_lines, 1, n), "\n")
    return F.when(F.size(all_lines) > n, F.concat(head, F.lit("\n..."))).otherwise(head)


def chunk_bounds(n_lines: Column, largest: int = 50, size: int = 40, overlap: int = 10) -> Column:
    """Line ranges (first, last; from 1) of overlapping chunks: one if all lines fit, else windows until one reaches the end."""
    step = max(1, size - overlap)
    starts = F.filter(F.sequence(F.lit(0), F.greatest(n_lines - 1, F.lit(0)), F.lit(step)), lambda s: (s == 0) | (s - step + size < n_lines))
    windows = F.transform(starts, lambda s: F.struct((s + 1).cast("int").alias("first"), F.least(s + size, n_lines).cast("int").alias("last")))
    whole = F.array(F.struct(F.lit(1).alias("first"), n_lines.cast("int").alias("last")))
    return F.when(n_lines <= largest, whole).otherwise(windows)


def truncate_bytes(text: Column, limit: int) -> Column:
    """The longest prefix of at most `limit` bytes that ends with a whole character."""
    # of the bytes of a prefix, a cut character shows as a replacement when decoded
    cut = F.substring(text.cast("binary"), 1, limit)
    tail = F.concat(F.lit("00000000"), F.hex(cut))
    # length of the broken character at the end: a lead byte with too few bytes after it
    last = [F.conv(F.substring(tail, -2 * k, 2), 16, 10).cast("int") for k in (1, 2, 3)]
    broken = F.when(last[0] >= 0xC0, 1).when((last[0] >= 0x80) & (last[1] >= 0xE0), 2).when((last[0] >= 0x80) & (last[1] >= 0x80) & (last[2] >= 0xF0), 3).otherwise(0)
    # the next byte tells whether the last character goes on
    goes_on = F.conv(F.hex(F.substring(text.cast("binary"), limit + 1, 1)), 16, 10).cast("int").between(0x80, 0xBF)
    size = F.when(goes_on, limit - broken).otherwise(limit)
    return F.when(F.octet_length(text) <= limit, text).otherwise(F.decode(F.substring(text.cast("binary"), F.lit(1), size), "UTF-8"))


def truncate_to_tokens(text: Column, most: int = 512) -> tuple[Column, Column]:
    """(text, truncated): four bytes count as a token."""
    over = F.floor(F.octet_length(text) / 4) > most
    return F.when(over, truncate_bytes(text, 4 * most)).otherwise(text), over


def snippet_preview(text: Column, limit: int = 200) -> Column:
    return F.when(F.octet_length(text) > limit, F.concat(truncate_bytes(text, limit), F.lit("..."))).otherwise(text)


def ref_name(name: Column) -> Column:
    """A ref as a folder's name."""
    return F.regexp_replace(F.regexp_replace(name, "[^A-Za-z0-9._-]", "-"), "^-+|-+$", "")


def identifiers(text: Column, least: int = 3) -> Column:
    """Distinct words of a question that may name something, in order."""
    words = F.regexp_extract_all(text, F.lit(r"([A-Za-z_][A-Za-z0-9_]*)"), F.lit(1))
    return F.array_distinct(F.filter(words, lambda w: (F.length(w) >= least) & ~F.lower(w).isin(*STOP_WORDS)))


def strip_generics(name: Column, depth: int = 3) -> Column:
    """Drop what stands between <> or [], nested up to `depth`."""
    for _ in range(depth):
        name = F.regexp_replace(name, r"<[^<>]*>|\[[^\[\]]*\]", "")
    return F.trim(name)


def call_target(name: Column) -> Column:
    """The callee's plain name: without new, await, marks and turbofish."""
    name = F.regexp_replace(F.trim(name), r"^(new|await)\s+", "")
    name = F.regexp_replace(name, "[?!]+$", "")
    return F.regexp_replace(name, r"::<[^<>]*(<[^<>]*>[^<>]*)*>", "")


def last_segment(name: Column) -> Column:
    return F.regexp_extract(name, r"([^.:]*)$", 1)


def shannon_entropy(text: Column) -> Column:
    """Entropy in bits of the byte frequencies."""
    # one pass over the sorted bytes: the sum of n log n over the runs of equal ones
    codes = F.array_sort(F.regexp_extract_all(F.hex(text.cast("binary")), F.lit("(..)"), F.lit(1)))
    part = lambda n: F.when(n > 0, n * F.log2(n)).otherwise(0.0)
    begin = F.struct(F.lit("").alias("code"), F.lit(0.0).alias("n"), F.lit(0.0).alias("total"))

    def step(state: Column, code: Column) -> Column:
        same = state["code"] == code
        return F.struct(code.alias("code"), F.when(same, state["n"] + 1.0).otherwise(1.0).alias("n"), F.when(same, state["total"]).otherwise(state["total"] + part(state["n"])).alias("total"))

    n = F.size(codes).cast("double")
    total = F.aggregate(codes, begin, step, lambda s: s["total"] + part(s["n"]))
    return F.when(n > 0, F.greatest(F.log2(n) - total / n, F.lit(0.0))).otherwise(0.0)


def redact(text: Column, rules=REDACTION_RULES) -> Column:
    """All matches of each rule replaced by its placeholder, rule after rule."""
    for _, pattern, placeholder in sorted(rules):
        text = F.regexp_replace(text, pattern, placeholder)
    return text


def redaction_counts(text: Column, rules=REDACTION_RULES) -> dict[str, Column]:
    """Matches of each rule on what the rules before it have left."""
    out = {}
    for category, pattern, placeholder in sorted(rules):
        out[category] = F.regexp_count(text, F.lit(pattern))
        text = F.regexp_replace(text, pattern, placeholder)
    return out


def high_entropy_tokens(text: Column, least_length: int = 20, least_bits: float = 3.5) -> Column:
    """Distinct tokens whose length and entropy make them look like secrets, longest first."""
    tokens = F.array_distinct(F.regexp_extract_all(text, F.lit(f"({ENTROPY_TOKEN})"), F.lit(1)))
    found = F.filter(tokens, lambda t: (F.length(t) >= least_length) & (shannon_entropy(t) >= least_bits))
    return F.reverse(F.array_sort(F.transform(found, lambda t: F.struct(F.length(t).alias("n"), t.alias("token")))))


def redact_high_entropy(text: Column, least_length: int = 20, least_bits: float = 3.5) -> Column:
    """Secret-like tokens replaced. A token stands between other characters, so each is replaced as a whole run."""
    edge = r"[A-Za-z0-9+/=_-]"
    return F.aggregate(
        high_entropy_tokens(text, least_length, least_bits),
        text,
        lambda t, x: F.regexp_replace(t, F.concat(F.lit(f"(?<!{edge})\\Q"), x["token"], F.lit(f"\\E(?!{edge})")), F.lit("[REDACTED:high_entropy]")),
    )
