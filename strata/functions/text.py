"""Text functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space that trimming removes, in a form that Java's regular expressions and RE2 share.
WHITE = r"[ \t\n\r\f\x0B\x{00a0}\x{feff}]"
TRIM = rf"^{WHITE}+|{WHITE}+\z"

# Symbolic abbreviations of context text, then of symbolic encoding.
CONTEXT_RULES = ((r"(?i)\bdynamic programming\b", "DP"), (r"(?i)\brecursion\b", "REC"), (r"(?i)\bbinary search\b", "BS(log n)"), (r"(?i)\bfor loop over n elements\b", "LOOP[n]"), (r"(?i)\bdivide by 2\b", "/2"))
SYMBOLIC_RULES = (
    (r"(?i)dynamic programming", "DP"), (r"(?i)recursion", "REC"), (r"(?i)binary search", "BS(log n)"), (r"(?i)depth[- ]first search", "DFS"),
    (r"(?i)breadth[- ]first search", "BFS"), (r"(?i)time complexity", "T(n)"), (r"(?i)space complexity", "S(n)"), (r"(?i)big[- ]o\s*\(([^)]+)\)", "O($1)"),
)

# Secrets, then personal data; in order.
SECRETS = (
    (r"(?i)\bsk-[a-z0-9]{20,}\b", "[REDACTED_SECRET]"), (r"(?i)\bghp_[a-z0-9]{20,}\b", "[REDACTED_SECRET]"), (r"(?i)\bgho_[a-z0-9]{20,}\b", "[REDACTED_SECRET]"),
    (r"(?i)\bgithub_pat_[a-z0-9_]{20,}\b", "[REDACTED_SECRET]"), (r"\bAKIA[0-9A-Z]{16}\b", "[REDACTED_SECRET]"), (r"\bASIA[0-9A-Z]{16}\b", "[REDACTED_SECRET]"),
    (r"\bAIza[0-9A-Za-z\-_]{20,}\b", "[REDACTED_SECRET]"), (r"\bxox[baprs]-[0-9A-Za-z-]{10,}\b", "[REDACTED_SECRET]"),
    (r"(?i)\b(api[-_]?key|token|secret|password)\s*[:=]\s*([^\s'\"`]{6,})", "$1=[REDACTED_SECRET]"),
)
PERSONAL = ((r"(?i)[a-z0-9._%+-]+@[a-z0-9.-]+\.[a-z]{2,}", "[REDACTED_PII]"), (r"\b(?:\+?\d{1,3}[\s-]?)?(?:\(\d{2,4}\)[\s-]?)?\d{3}[\s-]?\d{4}\b", "[REDACTED_PII]"))


def ascii_bounds(pattern: str) -> str:
    r"""``pattern`` with ``\b`` where only ASCII letters, digits and underscores make words, as in RE2; Java takes other letters too."""
    return pattern.replace(r"\b", r"(?:(?<=\w)(?!\w)|(?<!\w)(?=\w))")


def simple_lower(text: Column) -> Column:
    """Lower case that keeps the number of characters: a capital I with a dot is an i."""
    return F.lower(F.translate(text, "\u0130", "i"))


def replace_all(text: Column, rules: tuple[tuple[str, str], ...]) -> Column:
    for pattern, by in rules:
        text = F.regexp_replace(text, pattern, by)
    return text


def trim(text: Column) -> Column:
    return F.regexp_replace(text, TRIM, "")


def cut(text: Column, most: int) -> Column:
    """At most ``most`` characters, the last of them an ellipsis if any are missing."""
    return F.when(F.length(text) <= most, text).otherwise(F.concat(F.substring(text, 1, most - 1), F.lit("…")))


def compress_context(text: Column) -> Column:
    return trim(replace_all(text, (*CONTEXT_RULES, (r"[ \t]+", " "), (r"\n{3,}", "\n\n"))))


def compress_summary(text: Column, most: int = 180) -> Column:
    return cut(compress_context(text), most)


def preview(text: Column, most: int = 320) -> Column:
    """The first six lines that aren't blank, joined by bars."""
    clean = replace_all(text, ((r"\r\n", "\n"), (r"[ \t]+", " ")))
    lines = F.slice(F.filter(F.transform(F.split(clean, "\n"), trim), lambda x: x != ""), 1, 6)
    return cut(F.array_join(lines, " | "), most)


def normalize_whitespace(text: Column) -> Column:
    return trim(replace_all(text, ((r"\r\n", "\n"), (r"[ \t]+", " "))))


def compact(text: Column) -> Column:
    return trim(F.regexp_replace(text, f"{WHITE}+", " "))


def dedupe_lines(text: Column) -> Column:
    """Trimmed lines without blanks, each once by its lower case, in order of first appearance."""
    lines = F.filter(F.transform(F.split(text, "\r?\n"), trim), lambda x: x != "")
    each = F.array_sort(F.transform(lines, lambda x, i: F.struct(F.lower(x).alias("low"), i.alias("i"), x.alias("x"))))
    # equal lines lie together, the first in front; each is held against the one before it
    before = F.concat(F.array(F.lit(None).cast("string")), F.transform(each, lambda e: e["low"]))
    firsts = F.filter(F.arrays_zip(each.alias("e"), before.alias("b")), lambda z: z["e"].isNotNull() & ~z["e"]["low"].eqNullSafe(z["b"]))
    ordered = F.array_sort(F.transform(firsts, lambda z: F.struct(z["e"]["i"].alias("i"), z["e"]["x"].alias("x"))))
    return F.array_join(F.transform(ordered, lambda r: r["x"]), "\n")


def last_place(text: Column, mark: str) -> Column:
    """The 0-based place of the last ``mark``, or -1."""
    at = F.instr(F.reverse(text), mark[::-1])
    return F.when(at > 0, F.length(text) - at - len(mark) + 1).otherwise(-1)


def trim_at_sentence(text: Column, most: int) -> Column:
    """Cut to ``most`` characters, at the last sentence end if that keeps 55 % of them."""
    head = F.substring(text, 1, most)
    end = F.greatest(*(last_place(head, m) for m in (". ", "; ", "\n")))
    return F.when(F.length(text) <= most, text).when(end * 100 >= most * 55, trim(head.substr(F.lit(1), end + 1))).otherwise(trim(head))


def compress_agent(text: Column, most: int = 320, keep_lines: bool = False) -> Column:
    """A text without repeated lines, or on one line, of at most ``most`` characters and an ellipsis; cut after a
    sentence, clause or phrase that ends beyond 55 % of them."""
    clean = dedupe_lines(text) if keep_lines else compact(text)
    head = F.substring(clean, 1, most)
    end = F.greatest(*(last_place(head, m) for m in (". ", "; ", ", ")))
    kept = F.when(end > int(most * 0.55), head.substr(F.lit(1), end + 1)).otherwise(head)
    return F.when(F.length(clean) <= most, clean).otherwise(F.concat(F.regexp_replace(kept, f"{WHITE}+$", ""), F.lit("…")))


def to_fixed(x: Column, places: int) -> Column:
    """A number as text with so many places."""
    return F.format_string(f"%.{places}f", x.cast("double"))


def encode_symbolic(text: Column) -> Column:
    return replace_all(text, SYMBOLIC_RULES)


def tokenize_words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), "[^a-z0-9_]+"), lambda x: F.length(x) > 1)


def tokenize_ngram(text: Column, most: int | None = None) -> Column:
    """Words of a-z, 0-9 and _, and every other visible character by itself."""
    found = F.regexp_extract_all(F.lower(text), F.lit(r"[a-z0-9_]+|[^\s]"), F.lit(0))
    return F.slice(found, 1, most) if most else found


def shingle(text: Column) -> Column:
    """Distinct words, and pairs of neighbours."""

    def of(w: Column) -> Column:
        pairs = F.zip_with(F.slice(w, F.lit(1), F.size(w) - 1), F.slice(w, F.lit(2), F.greatest(F.size(w) - 1, F.lit(0))), lambda a, b: F.concat_ws(" ", a, b))
        return F.when(F.size(w) > 1, F.array_union(w, pairs)).otherwise(F.array_distinct(w))

    return F.get(F.transform(F.array(tokenize_words(text)), of), F.lit(0))  # the words are found once


def fixed_chunks(text: Column, most: int = 800) -> Column:
    """Slices of ``most`` characters; none of the empty text."""
    n = F.ceil(F.length(text) / most).cast("int")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: text.substr(i * most + 1, F.lit(most)))).otherwise(F.array().cast("array<string>"))


#: What any secret, e-mail address or phone number must contain; most texts contain none and skip the rules.
SECRET_MARK, MAIL_MARK, PHONE_MARK = r"(?i)sk-|gh[po]_|github_pat_|AKIA|ASIA|AIza|xox[baprs]-|api[-_]?key|token|secret|password", "@", r"\d{3}[\s-]?\d{4}"


def guarded(has_mark, rules):
    return lambda t: F.when(has_mark(t), replace_all(t, rules)).otherwise(t)


def redact(text: Column, secrets: bool = True, personal: bool = True, custom: tuple[str, ...] = ()) -> Column:
    steps = []
    if secrets:
        steps.append((lambda t: t.rlike(SECRET_MARK), SECRETS))
    if personal:
        steps += [(lambda t: F.contains(t, F.lit(MAIL_MARK)), PERSONAL[:1]), (lambda t: t.rlike(PHONE_MARK), PERSONAL[1:])]
    made = F.array(text)  # a step's argument is evaluated once
    for has_mark, rules in steps:
        made = F.transform(made, guarded(has_mark, rules))
    return replace_all(F.get(made, F.lit(0)), tuple((p, "[REDACTED_CUSTOM]") for p in custom))


def estimate_tokens(text: Column) -> Column:
    return F.greatest(F.lit(1), F.ceil(F.length(text) / 4)).cast("long")


def route_label(path: Column) -> Column:
    return F.substring(replace_all(path, ((r"[0-9a-fA-F]{8,}", ":id"), (r"/{2,}", "/"))), 1, 180)


def basename(path: Column) -> Column:
    return F.substring_index(F.regexp_replace(path, r"\\", "/"), "/", -1)


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./\\]+)$", 1))


def detect_language(path: Column) -> Column:
    e = extension(path)
    named = F.when(e.isin(".ts", ".tsx"), "typescript").when(e.isin(".js", ".jsx"), "javascript").when(e == ".py", "python").when(e.isin(".cpp", ".cc", ".cxx", ".hpp", ".h"), "cpp").when(e == ".java", "java")
    return named.otherwise(F.when(e == "", "unknown").otherwise(F.substring(e, 2, 100)))


def normalize_tags(tags: Column, most: int) -> Column:
    """Lower-case tags of letters, digits, ``_`` and ``-``, each once and in order."""
    clean = F.transform(tags, lambda t: F.regexp_replace(F.regexp_replace(trim(F.lower(t)), r"[^a-z0-9_-]+", "-"), r"^-+|-+$", ""))
    return F.slice(F.array_distinct(F.filter(clean, lambda t: t.rlike(r"^[a-z][a-z0-9_-]{1,23}$"))), 1, most)


def merge_tags(first: Column, second: Column, most: int = 24) -> Column:
    return F.slice(F.array_distinct(F.concat(first, second)), 1, most)
