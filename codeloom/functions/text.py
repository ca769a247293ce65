"""Column functions over text: lines, tokens, labels, signatures, snippets.

All of them are built-in expressions evaluated row by row on the JVM, so none
adds a shuffle and none leaves the executor's memory model.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from codeloom import rules
from codeloom.functions.paths import any_of

WHITE = " \t\n\r\x0b\x0c"
WORD_BREAK = r"[^\p{L}\p{M}\p{N}_]+"
_BREAK = "\x00"


def trim(col: Column) -> Column:
    return F.trim(col, F.lit(WHITE))


def ltrim(col: Column) -> Column:
    return F.ltrim(col, F.lit(WHITE))


def lines(text: Column) -> Column:
    """Lines of a text; one final line break does not open another line."""
    body = F.split(F.regexp_replace(text, "\r?\n\\z", ""), "\r?\n", -1)
    return F.when(text == "", F.array().cast("array<string>")).otherwise(body)


def occurrences(text: Column, char: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(char), F.lit("")))


# --- tokens -------------------------------------------------------------------
def identifier_tokens(text: Column) -> Column:
    """Split on non-alphanumerics and between a lower and an upper case letter."""
    spaced = F.regexp_replace(text, "([a-z])([A-Z])", "$1 $2")
    return F.filter(F.split(spaced, "[^A-Za-z0-9]+"), lambda t: t != "")


def is_label_token(tok: Column) -> Column:
    """At least three characters, no stop word or verb, not more digits than letters."""
    letters = F.length(F.translate(tok, "0123456789", ""))
    banned = rules.LABEL_STOPWORDS + rules.LABEL_VERBS
    return (F.length(tok) >= 3) & (2 * letters >= F.length(tok)) & ~F.lower(tok).isin(banned)


def label_tokens(text: Column) -> Column:
    return F.transform(F.filter(identifier_tokens(text), is_label_token), F.lower)


def mostly_letters(phrase: Column) -> Column:
    digits = F.length(F.regexp_replace(phrase, r"\P{N}", ""))
    letters = F.length(F.regexp_replace(phrase, r"\P{L}", ""))
    return (letters > 0) & (digits <= letters)


def words(text: Column) -> Column:
    """Words of letters, digits and underscores, as a search by whole word sees them."""
    return F.filter(F.split(text, WORD_BREAK), lambda t: t != "")


def word_pairs(text: Column) -> Column:
    """Neighbouring words as they stand in the text, with what is between them."""
    between = F.split(text, r"[\p{L}\p{M}\p{N}_]+", -1)
    found = words(text)
    n = F.greatest(F.size(found) - 1, F.lit(0))
    # the first and last piece of ``between`` lie before and behind all words
    ends = F.zip_with(F.slice(between, F.lit(2), n), F.slice(found, F.lit(2), n), lambda gap, word: F.concat(gap, word))
    return F.zip_with(F.slice(found, F.lit(1), n), ends, lambda word, end: F.concat(word, end))


def bigrams(tokens: Column) -> Column:
    n = F.size(tokens)
    heads = F.slice(tokens, F.lit(1), F.greatest(n - 1, F.lit(0)))
    tails = F.slice(tokens, F.lit(2), F.greatest(n - 1, F.lit(0)))
    return F.zip_with(heads, tails, lambda a, b: F.concat_ws(" ", a, b))


def noun_phrases(text: Column) -> Column:
    """Runs of capitalised, mixed-case, snake_case or alphanumeric words.

    Words that end a run become a break mark, so that joining and splitting the
    token array again yields the runs in one linear pass.
    """
    found = F.regexp_extract_all(
        text, F.lit(r"(?<![\p{L}\p{M}\p{N}_])[A-Za-z_][A-Za-z0-9_]*(?![\p{L}\p{M}\p{N}_])"), F.lit(0))

    def marked(tok: Column) -> Column:
        stop = F.lower(tok).isin(rules.PHRASE_STOPWORDS) | (F.length(tok) < 2)
        noun = tok.rlike("[A-Z]") | tok.contains("_") | (
            tok.rlike("[0-9]") & tok.rlike("[A-Za-z]") & (F.length(tok) > 2))
        return F.when(~stop & noun, tok).otherwise(F.lit(_BREAK))

    runs = F.split(F.array_join(F.transform(found, marked), " "), f" ?{_BREAK} ?")
    return F.array_distinct(F.filter(F.transform(runs, trim), lambda p: F.length(p) > 1))


def title_words(phrase: Column) -> Column:
    return F.array_join(
        F.transform(F.split(phrase, " +"),
                    lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substr(w, F.lit(2)))), " ")


# --- labels, roles ------------------------------------------------------------
def common_prefix(low: Column, high: Column) -> Column:
    """Longest common prefix of a set, from its smallest and largest member."""
    n = F.least(F.length(low), F.length(high))
    size = F.aggregate(
        F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>")),
        F.lit(0),
        lambda acc, i: F.when((acc == i - 1) & (F.substr(low, i, F.lit(1)) == F.substr(high, i, F.lit(1))), i)
        .otherwise(acc))
    return F.substr(low, F.lit(1), size)


def prefix_label(low: Column, high: Column) -> Column:
    """Common prefix without trailing ``_`` then ``::``; NULL below three bytes."""
    cleaned = F.regexp_replace(F.regexp_replace(common_prefix(low, high), "_+$", ""), "(::)+$", "")
    return F.when(F.octet_length(cleaned) >= 3, cleaned)


def first_rule(table, test, default):
    """First matching rule of an ordered table; ``test`` turns a term into a condition."""
    out = default
    for value, terms in reversed(list(table)):
        out = F.when(any_of(test(t) for t in terms), value).otherwise(out)
    return out


def label_role(label: Column, table=None) -> Column:
    low = F.lower(label)
    return first_rule(table or rules.LABEL_ROLES, low.contains, F.lit(None).cast("string"))


def member_rule_number(name: Column, table=None) -> Column:
    """Position of the first role rule a member name meets, NULL for none.

    The minimum over a community's members is the role of the community, so the
    decision is a plain aggregate rather than a scan of a member array.
    """
    low = F.lower(name)
    table = table or rules.MEMBER_ROLES
    return first_rule([(i, terms) for i, (_, terms) in enumerate(table)], low.contains, F.lit(None).cast("int"))


def role_of(label: Column, rule_number: Column, table=None, label_table=None) -> Column:
    """Role by label, else by the first member rule met; both rule tables may be the caller's."""
    table = table or rules.MEMBER_ROLES
    by_member = F.lit(rules.DEFAULT_ROLE)
    for i, (role, _) in enumerate(table):
        by_member = F.when(rule_number == i, role).otherwise(by_member)
    return F.coalesce(label_role(label, label_table), by_member)


def community_summary(label: Column, n_symbols: Column, role: Column) -> Column:
    return F.format_string(rules.COMMUNITY_SUMMARY, F.coalesce(label, F.lit("unnamed")), n_symbols, role)


# --- symbols ------------------------------------------------------------------
def parameter_list(parameters: Column) -> Column:
    listed = F.array_join(F.transform(parameters, lambda p: F.concat(p["name"], F.lit(": "), p["type"])), ", ")
    return F.coalesce(listed, F.lit(""))


def _optional(prefix: str, col: Column, suffix: str = "") -> Column:
    return F.coalesce(F.concat(F.lit(prefix), col, F.lit(suffix)), F.lit(""))


def signature(kind, name, parameters, return_type, generics) -> Column:
    """Short signature; the stored generics already carry brackets and get a second pair."""
    wrapped = _optional("<", generics, ">")
    return (F.when(kind.isin("function", "method"),
                   F.concat(F.lit("fn "), name, wrapped, F.lit("("), parameter_list(parameters), F.lit(")"),
                            _optional(" -> ", return_type)))
            .when(kind.isin("struct", "enum", "trait"), F.concat(kind, F.lit(" "), name, wrapped))
            .when(kind == "type_alias", F.concat(F.lit("type "), name)))


def full_signature(name, visibility, modifiers, generics, parameters, return_type) -> Column:
    """Signature as documentation prints it, with visibility and modifiers."""
    head = F.concat_ws(" ", visibility, modifiers, F.lit("fn"), name)
    return F.concat(head, F.coalesce(generics, F.lit("")), F.lit("("), parameter_list(parameters), F.lit(")"),
                    _optional(" -> ", return_type))


def span_reference(start, end, start_row, end_row) -> Column:
    as_line = F.coalesce(F.concat(F.lit("L"), start_row, F.lit("-L"), end_row), F.concat(F.lit("L"), start_row))
    return F.coalesce(F.concat(start, F.lit("-"), end), as_line, F.lit("unknown"))


def _title(kind: Column, table: dict, default) -> Column:
    out = default
    for key, value in table.items():
        out = F.when(kind == key, value).otherwise(out)
    return out


def symbol_summary(kind, name, docs, limit: int = 200) -> Column:
    first = lines(docs)[0]
    cut = F.when(F.length(first) > limit, F.concat(F.substring(first, 1, limit), F.lit("..."))).otherwise(first)
    generic = F.concat(_title(kind, rules.SUMMARY_TITLES, kind), F.lit(" "), name)
    return F.coalesce(cut, generic)


def symbol_caption(kind, name, visibility, parameters) -> Column:
    n = F.coalesce(F.size(parameters), F.lit(0))
    return F.concat(_title(kind, rules.KIND_TITLES, F.lit("Symbol")), F.lit(" '"), name, F.lit("'"),
                    _optional(" (", visibility, ")"),
                    F.when(n > 0, F.concat(F.lit(" with "), n, F.lit(" parameter(s)"))).otherwise(""))


def snippet(text: Column, name: Column, max_chars: int = 150) -> Column:
    """Text around the first hit, trimmed to whole lines; counted in characters."""
    half = max_chars // 2
    at = F.instr(text, name) - 1
    start = F.greatest(at - half, F.lit(0))
    end = F.least(at + F.length(name) + half, F.length(text))
    part = F.substr(text, start + 1, end - start)
    first = F.instr(part, F.lit("\n"))
    part = F.when((first > 0) & (start > 0), F.substr(part, first + 1)).otherwise(part)
    part = F.when(end < F.length(text), F.regexp_replace(part, "\n[^\n]*\\z", "")).otherwise(part)
    return F.when(at >= 0, trim(part)).otherwise(F.substring(text, 1, max_chars))


def span_numbers(chunk_id: Column) -> Column:
    """``a-b`` as two numbers, anything else as zeros."""
    both = chunk_id.rlike("^[0-9]+-[0-9]+$")
    part = lambda i: F.when(both, F.try_to_number(F.split(chunk_id, "-")[i], F.lit("9" * 18)).cast("bigint"))
    return F.struct(F.coalesce(part(0), F.lit(0).cast("bigint")).alias("line_start"),
                    F.coalesce(part(1), F.lit(0).cast("bigint")).alias("line_end"))


def source_span(text: Column, start: Column, end: Column) -> Column:
    """Bytes ``start..end`` of a text; the whole text if the span is not valid."""
    raw = F.encode(text, "UTF-8")
    part = F.substr(raw, (start + 1).cast("int"), (end - start).cast("int"))
    valid = (start < F.octet_length(text)) & (end <= F.octet_length(text)) & (start <= end) & F.is_valid_utf8(part)
    return F.when(valid, F.decode(part, "UTF-8")).otherwise(text)


PROMPT_TASK = "Say briefly, for someone new to this code base, what the definition below is for."


def explanation_prompt(kind, name, sig, summary, code, task: str = PROMPT_TASK, code_chars: int = 500) -> Column:
    """Prompt row for a language model: the task, known facts by line, then the code up to ``code_chars``."""
    return F.concat(
        F.lit(f"{task}\n"), F.lit("kind="), kind, F.lit("\nname="), name, _optional("\nsignature=", sig),
        F.when(F.length(summary) > 0, F.concat(F.lit("\nsummary="), summary)).otherwise(""),
        _optional("\ncode:\n", F.substring(code, 1, code_chars)), F.lit("\nanswer:"))


def clean_response(text: Column) -> Column:
    kept = F.filter(lines(trim(text)), lambda l: trim(l) != "")
    return F.array_join(F.slice(kept, 1, 3), " ")


# --- validation ---------------------------------------------------------------
def validate_content(text: Column) -> Column:
    opened, closed = occurrences(text, "{"), occurrences(text, "}")
    balanced = opened == closed
    none = F.array().cast("array<string>")
    return F.struct(
        balanced.alias("valid"),
        F.when(balanced, none).otherwise(
            F.array(F.format_string("Unbalanced braces: %d open, %d close", opened, closed))).alias("errors"),
        F.when(text == "", F.array(F.lit("File content is empty"))).otherwise(none).alias("warnings"))
