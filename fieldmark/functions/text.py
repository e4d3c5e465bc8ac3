"""Text functions over columns: normalising, splitting and packing, identifiers, session phrases."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

# Patterns and word lists that results depend on.
TOKEN = r"[A-Za-z0-9][A-Za-z0-9._/-]*"
HINT_WORDS = "err(?:or)?|code|pn|p/n|part|mpn|msg|fault|fail|procedure|proc|bulletin|sb|ad|tid|doc|docid|manual|amm|cmm|ipc|rev|step|assembly|assy"
SUBSYSTEMS = "hydraulics?|fuel system|electrical|avionics|landing gear|oxygen|pneumatics?|cooling|lubrication|navigation|pressurization|sensor|actuator|pump|valve|filter"
ASSET_WORDS = "asset|aircraft|vehicle|unit|truck|rig|airframe"
ACTION_VERBS = "replaced|swapped|reset|cleaned|inspected|torqued|checked|removed|installed|reinstalled|tightened|lubricated"
DEICTIC = r"\b(it|its|this|that|these|those|the\s+same|same|also|again|still|there|their)\b|\babout (?:the|that|this)\b|\bother\b"
EXPANSION_STOP = ("the", "a", "an", "of", "and", "or", "is", "are")

# Word boundaries as ASCII sees them; the engine's own also count accented letters.
BEFORE, AFTER = "(?<![A-Za-z0-9_])", "(?![A-Za-z0-9_])"

MAX_CHARS, OVERLAP_CHARS = 1600, 200


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once: a lambda's argument is a variable, where a column used twice is computed twice."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def trim_space(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def normalize_text(c: Column) -> Column:
    """Line ends as LF, no-break spaces as spaces, and no blanks at the ends of lines."""
    c = F.translate(F.regexp_replace(c, r"\r\n?", "\n"), "\u00a0", " ")
    return F.regexp_replace(c, r"[ \t]+(?=\n|\z)", "")


def split_sentences(c: Column) -> Column:
    """Sentences: cut after ``.``, ``!`` or ``?`` before white space and an upper-case letter, quote or bracket. No text is lost."""
    parts = F.split(trim_space(c), r"(?<=[.!?])\s+(?=[\p{Lu}\"'\[(])")
    return F.filter(F.transform(parts, trim_space), lambda s: s != "")


def hard_pieces(sentence: Column, max_chars: int) -> Column:
    """A sentence in pieces of at most ``max_chars``: cut at the last space, or in a word where that would lose half a piece."""
    pattern = rf"(?s).{{{max_chars // 2},{max_chars}}}(?=\s|\z)|.{{1,{max_chars}}}"
    pieces = F.transform(F.regexp_extract_all(sentence, F.lit(pattern), 0), trim_space)
    return F.when(F.length(sentence) <= max_chars, F.array(sentence)).otherwise(F.filter(pieces, lambda p: p != ""))


def pack_sentences(sentences: Column, max_chars: int) -> Column:
    """Sentences joined by a space into chunks of at most ``max_chars``. A fold over lengths alone finds where chunks begin; then each is
    joined once."""
    start = F.struct(F.array().cast("array<int>").alias("cuts"), F.lit(max_chars).alias("held"), F.lit(0).alias("at"))

    def add(acc: Column, n: Column) -> Column:
        fits = acc["held"] + 1 + n <= max_chars
        return F.struct(F.when(fits, acc["cuts"]).otherwise(F.concat(acc["cuts"], F.array(acc["at"]))).alias("cuts"), F.when(fits, acc["held"] + 1 + n).otherwise(n).alias("held"), (acc["at"] + 1).alias("at"))

    def joined(pieces: Column, cuts: Column) -> Column:
        return F.transform(cuts, lambda c, i: F.array_join(F.slice(pieces, c + 1, F.coalesce(F.get(cuts, i + 1), F.size(pieces)) - c), " "))

    pieces = F.flatten(F.transform(sentences, lambda s: hard_pieces(s, max_chars)))
    return let(pieces, lambda p: let(F.aggregate(F.transform(p, F.length), start, add, lambda acc: acc["cuts"]), lambda cuts: joined(p, cuts)))


def chunk_text(c: Column, max_chars: int = MAX_CHARS, overlap_chars: int = OVERLAP_CHARS) -> Column:
    """Chunks of a text. Blank lines are hard boundaries; a short paragraph is one chunk, a long one is packed by sentences.

    Then each chunk but the first begins with up to ``overlap_chars`` of the one before, from its first whole word, unless it
    already does; ``max_chars`` bounds a chunk before that.
    """
    if not isinstance(max_chars, int) or max_chars < 100:
        raise ValueError("max_chars must be an integer of at least 100")
    if not isinstance(overlap_chars, int) or not 0 <= overlap_chars < max_chars:
        raise ValueError("overlap_chars must be an integer from 0 to less than max_chars")
    paragraphs = F.transform(F.split(normalize_text(c), r"\n\s*\n"), lambda p: trim_space(F.regexp_replace(p, r"\s+", " ")))
    packed = F.flatten(F.transform(F.filter(paragraphs, lambda p: p != ""), lambda p: F.when(F.length(p) <= max_chars, F.array(p)).otherwise(pack_sentences(split_sentences(p), max_chars))))
    return let(packed, lambda chunks: overlap(chunks, overlap_chars)) if overlap_chars else packed


def has_chunks(c: Column) -> Column:
    """Whether :func:`chunk_text` gives any chunk of a text: something in it is no white space."""
    return F.coalesce(F.rlike(c, F.lit(r"[^\s\u00a0]")), F.lit(False))


def overlap(chunks: Column, chars: int) -> Column:
    def tail(previous: Column) -> Column:
        end = F.substring(previous, -chars, chars)
        return trim_space(F.when(F.instr(end, " ") > 0, F.regexp_replace(end, r"^[^ ]* ", "")).otherwise(end))

    def head(chunk: Column, i: Column) -> Column:
        before = tail(F.get(chunks, i - 1))
        return F.when((i == 0) | (before == "") | F.startswith(chunk, before), chunk).otherwise(F.concat(before, F.lit(" "), chunk))

    return F.transform(chunks, head)


def is_identifier(t: Column) -> Column:
    """Whether a token that holds a digit is meant to be matched literally: capitals or separators with digits, or a long number."""
    digits = F.length(t) - F.length(F.translate(t, "0123456789", ""))
    return (F.length(t) >= 3) & (t.rlike("[A-Z]") | ((digits >= 3) & (F.length(t) >= 5)) | (t.rlike("[-_./]") & t.rlike("[A-Za-z]")))


def identifier_tokens(c: Column) -> Column:
    """Identifiers in order, each once. All hold a digit, so only such tokens are extracted."""
    tokens = F.transform(F.regexp_extract_all(c, F.lit(rf"(?=[A-Za-z._/-]*+[0-9]){TOKEN}"), 0), lambda t: F.regexp_replace(t, "[.,;:]+$", ""))
    return F.array_distinct(F.filter(tokens, is_identifier))


def exact_terms(c: Column) -> Column:
    """Identifier tokens in order, then codes that a hint word announces, unless a term found before contains them."""
    hints = F.regexp_extract_all(c, F.lit(rf"(?i){BEFORE}(?:{HINT_WORDS}){AFTER}[-.:_ ]*\s*([a-z0-9][a-z0-9-]*)"), 1)

    def add(found: Column, hint: Column) -> Column:
        held = F.exists(found, lambda t: F.contains(F.lower(t), F.lower(hint)))
        good = (F.length(hint) >= 2) & hint.rlike("[0-9]") & ~held
        return F.when(good, F.concat(found, F.array(hint))).otherwise(found)

    return F.aggregate(hints, identifier_tokens(c), add)


def match_tokens(text: Column) -> Column:
    """Lower-case tokens of a text clause."""
    return F.filter(F.split(F.lower(text), "[^a-z0-9·]+"), lambda t: t != "")


def matches_all_tokens(field: Column, text: Column) -> Column:
    """Whether a field contains all tokens of a text, of which there must be one."""
    tokens = match_tokens(text)
    return F.coalesce((F.size(tokens) > 0) & F.forall(tokens, lambda t: F.contains(F.lower(field), t)), F.lit(False))


def contained_terms(terms: Column, content: Column, keywords: Column) -> Column:
    """Those of ``terms`` that the content or a keyword contains, case ignored."""
    words = F.coalesce(keywords, F.array().cast("array<string>"))
    return F.filter(terms, lambda t: F.contains(F.lower(F.coalesce(content, F.lit(""))), F.lower(t)) | F.exists(words, lambda k: F.contains(F.lower(k), F.lower(t))))


def asset_of(c: Column) -> Column:
    """The asset a text names: a serial number, or else what follows a designation word; null if none."""
    msn = F.regexp_extract(c, rf"(?i){BEFORE}MSN\s?([0-9]{{3,}}){AFTER}", 1)
    named = F.regexp_extract(c, rf"(?i){BEFORE}(?:{ASSET_WORDS})\s+(?:id\s+)?([A-Za-z0-9][A-Za-z0-9-]{{2,}})", 1)
    return F.when(msn != "", F.concat(F.lit("MSN"), msn)).otherwise(F.nullif(named, F.lit("")))


def canonical(word: Column) -> Column:
    """A subsystem word in lower case and without a plural s; blank ones are null."""
    word = F.lower(trim_space(word))
    singular = F.when((F.length(word) > 3) & word.endswith("s") & ~word.endswith("ss"), F.regexp_replace(word, "s$", "")).otherwise(word)
    return F.nullif(singular, F.lit(""))


def subsystem_of(c: Column) -> Column:
    """The first subsystem word of a text in canonical form; null if none."""
    return canonical(F.regexp_extract(c, rf"(?i){BEFORE}({SUBSYSTEMS}){AFTER}", 1))


def actions_in(c: Column) -> Column:
    """Actions a text reports as taken: the verb and the first two words of its object, each once."""
    pattern = F.lit(rf"(?i){BEFORE}({ACTION_VERBS}){AFTER}\s+([^.,;!?]*?)(?=\s+and\s+|[,;!?]|$)")
    pairs = F.zip_with(F.regexp_extract_all(c, pattern, 1), F.regexp_extract_all(c, pattern, 2), lambda v, o: F.struct(F.lower(v).alias("verb"), F.array_join(F.slice(F.split(F.lower(trim_space(o)), r"\s+"), 1, 2), " ").alias("object")))
    return F.array_distinct(F.transform(F.filter(pairs, lambda p: p["object"] != ""), lambda p: F.concat(p["verb"], F.lit(" "), p["object"])))


def is_context_dependent(c: Column) -> Column:
    """Whether a query leans on its session: at most six words, or a word that points elsewhere. Blank ones do not."""
    few = F.regexp_count(c, F.lit("[A-Za-z0-9][A-Za-z0-9-]*")) <= 6
    return (trim_space(c) != "") & (few | c.rlike(f"(?i){DEICTIC}"))


def expand_query(query: Column, component: Column, asset: Column) -> Column:
    """A query that leans on its session with the session's subsystem and asset behind it, as far as it does not name them."""
    query = trim_space(query)

    def missing(t: Column) -> Column:
        named = F.concat(F.lit(f"(?i){BEFORE}"), F.regexp_replace(t, r"([.*+?^${}()|\[\]\\])", r"\\$1"), F.lit(AFTER))
        return t.isNotNull() & (t != "") & ~F.lower(t).isin(*EXPANSION_STOP) & ~F.rlike(query, named)

    more = F.filter(F.array(component, asset), missing)
    return F.when(is_context_dependent(query) & (F.size(more) > 0), F.concat(query, F.lit(" ("), F.array_join(more, ", "), F.lit(")"))).otherwise(query)
