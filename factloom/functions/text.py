"""Text identity, shape, prompt classes, capture scoring and screening as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalized(text: Column) -> Column:
    """Lower case, ASCII white space collapsed to single spaces and stripped."""
    return F.trim(F.regexp_replace(F.lower(text), r"[ \t\n\r\f\x0B]+", " "))


def content_id(kind: Column, topic: Column, claim: Column) -> Column:
    """type_ and 12 hex digits of SHA-1 over type, topic and normalised claim."""
    nul = F.char(F.lit(0))
    return F.concat(kind, F.lit("_"), F.substring(F.sha1(F.concat(kind, nul, topic, nul, normalized(claim)).cast("binary")), 1, 12))


def fingerprint(text: Column) -> Column:
    """First 16 hex digits of SHA-256 of the normalised text."""
    return F.substring(F.sha2(normalized(text).cast("binary"), 256), 1, 16)


def token_estimate(text: Column) -> Column:
    """A token per four characters, at least one."""
    return F.greatest(F.lit(1), F.floor((F.length(text) + 3) / 4)).cast("int")


def word_count(text: Column) -> Column:
    return F.size(F.filter(F.split(text, r"\s+"), lambda w: w != ""))


def token_set(text: Column) -> Column:
    """Distinct runs of ASCII letters and digits, lower-cased."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"[a-z0-9]+"), F.lit(0)))


def jaccard(a: Column, b: Column) -> Column:
    """Shared over all members of two sets; 0 where both are empty."""
    shared, every = F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))
    return F.when(every > 0, shared / every).otherwise(0.0)


def first_match(rules: list[tuple[str, object]], default) -> Column:
    out = None
    for condition, value in rules:
        out = F.when(condition, value) if out is None else out.when(condition, value)
    return out.otherwise(default)


# --- fixed values: prompt classes, signals, drops, document shape -------------------------------------
#: Prompt classes in order of priority: name, confidence, pattern.
PROMPT_CLASSES = (
    ("contradictory", 0.9, r"\b(but (we|i) (said|decided)|didn'?t we|isn'?t .* already|thought (we|that)|haven'?t we)\b"),
    ("implementation", 0.7, r"\b(add|fix|refactor|remove|rename|implement|build|wire|replace|migrate|update|patch|tweak)\b"),
    ("navigational", 0.8, r"\b(where (is|do|does)|show me|which file|find|locate|grep|path to|file for)\b"),
    ("semantic", 0.6, r"\b(why (does|is|do|are)|how does|is it safe|what happens|is .* allowed|explain)\b"),
)
DEFAULT_CLASS = ("semantic", 0.3)
#: Signals of a standing rule and their weights.
SIGNALS = (
    ("universal", 3, r"\b(always|never|every|each|all|everyone|everybody|any ?time|in all cases)\b"),
    ("exception", 3, r"\b(except|unless|other than|apart from|besides)\b"),
    ("policy", 2, r"\b(must|should|shall|has to|have to|needs? to|is required to|not allowed)\b"),
    ("prohibition", 2, r"\b(don'?t ever|do not ever|never|avoid|stop doing|no longer)\b"),
    ("default", 2, r"\b(by default|default(s)? to|convention|we (use|prefer|treat)|prefer(s|red)? to|stick to)\b"),
    ("conditional", 2, r"\b(if .+ then|whenever|when(ever)? .+, )\b"),
    ("correction", 1, r"\b(actually|instead of|not .+ but|rather than|correction)\b"),
    ("scope", 1, r"\b(only|just for|applies to|for all|for every)\b"),
    ("declarative", 1, r"\b(is|are|was|were|gets|goes|has|have|belongs|lives|runs|uses|stays)\b"),
)
VERBS = r"(add|fix|remove|delete|make|update|change|implement|refactor|create|build|run|write|put|move|rename|install|commit|push|check|look|show|give|send|open|close|start|stop|continue|try|redo|undo|revert)"
IMPERATIVE = rf"^\s*(please\s+)?{VERBS}\b"
SPOKEN_IMPERATIVE = rf"^\s*(?:(?:ok|okay|so|now|first|then|also|and also|pls|please|lets|let's)[,]?\s+)+{VERBS}\b"
ADDRESSED = r"\b(can|could|would) (u|you)\b|\bu are\b|\bif u\b|\bu (just )?(have|need) to\b|\bwant (u|you) to\b|\bur\b"
DEICTIC = r"\b(this|that|these|those|here|there|above|below|the current|it)\b"
QUESTION = r"\?\s*$"
NOT_USER_TEXT = r"^\s*(<(system-reminder|teammate-message|local-command|command-name|command-message|summary)|Another Claude session sent|Caveat: The messages below|Background command|The core finding:|\[Image[: \]])"
MACHINE_AUTHORED = (
    r"(session-scoped|Stop hook is now active|transcript evidence|\bthe (assistant|agent|transcript|condition|user has)\b|"
    r"\bassistant('s)? (states|confirmed|explicitly|has|acknowledges)\b|\b(is|was) (NOT |not )?(satisfied|complete)\b|^\s*\(\d+\)|^\s*\[.{0,80}\]:)"
)
MARKDOWN_LINE = r"^\s*(#{1,6}\s|[-*+]\s|\d+[.)]\s|\||>\s|```)"
MARKDOWN_TABLE = r"\|\s*-{2,}|\|.*\|.*\|"
LEADING_QUOTE = "^\\s*[\\[\"'\u201c]"
NARRATION = r"\btranscripts?\b.{0,80}\b(provides?|shows?|evidence|indicates?)\b|\bevidence of\b"
META_CONVERSATION = r"\b(this|the current) (conversation|session|chat)\b|\byour review\b|\bmemory note\b|\bwaiting on you\b"
FIRST_PERSON = r"\bi (wish|was wondering|think|guess|have gotten|want u|am|was)\b"
FRAGMENT_LEAD = r"^\s*(for|and|or|but|with|on|in|to|of|by)\b"
FRAGMENT_VERB = r"\b(must|should|shall|will|would|can|could|is|are|was|were|be|has|have|had|do|does|need|needs)\b"
MIN_CHARS, MAX_CHARS, FRAGMENT_CHARS, THRESHOLD = 25, 400, 60, 4
MESSAGE_CHARS, DOCUMENT_LINES, DOCUMENT_SHARE = 3000, 4, 0.30
UNIT_BREAK = r"(?<=[.!?;])\s+|\n+|\s*->\s*|;"
# -------------------------------------------------------------------------------------------------------


def matches(text: Column, pattern: str) -> Column:
    """Whether the pattern is found, without regard to case."""
    return text.rlike("(?i)" + pattern)


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def prompt_class(text: Column) -> Column:
    return first_match([(matches(text, p), F.lit(n)) for n, _, p in PROMPT_CLASSES], F.lit(DEFAULT_CLASS[0]))


def prompt_confidence(text: Column) -> Column:
    return first_match([(matches(text, p), F.lit(c)) for _, c, p in PROMPT_CLASSES], F.lit(DEFAULT_CLASS[1]))


def _scored(unit: Column) -> tuple[Column, list[tuple[Column, str, int]]]:
    """Whether a clause is scored at all, and (condition, name, weight) of signals and penalties."""
    signals = [(matches(unit, p), n, w) for n, w, p in SIGNALS]
    pointing = F.size(F.regexp_extract_all(unit, F.lit("(?i)" + DEICTIC), F.lit(0))) >= 2
    penalties = [
        (matches(unit, IMPERATIVE) | matches(unit, SPOKEN_IMPERATIVE), "-imperative", -2),
        (matches(unit, ADDRESSED), "-addressed", -2),
        (pointing & ~signals[0][0], "-deictic", -2),
    ]
    any_signal = signals[0][0]
    for condition, _, _ in signals[1:]:
        any_signal = any_signal | condition
    fits = F.length(unit).between(MIN_CHARS, MAX_CHARS) & ~unit.rlike(QUESTION) & any_signal
    return fits, signals + penalties


def capture_score(unit: Column) -> Column:
    """Sum of the weights of matching signals and penalties; 0 outside 25 to 400 characters, for questions
    and without any signal."""
    fits, every = _scored(unit)
    return F.when(fits, sum((F.when(c, w).otherwise(0) for c, _, w in every), F.lit(0))).otherwise(0).cast("int")


def capture_signals(unit: Column) -> Column:
    """Names of the signals and penalties, in their order; none where the score is 0 by shape."""
    fits, every = _scored(unit)
    names = F.filter(F.array(*[F.when(c, F.lit(n)) for c, n, _ in every]), lambda x: x.isNotNull())
    return F.when(fits, names).otherwise(F.array().cast("array<string>"))


def proposed_type(signals: Column) -> Column:
    has = lambda name: F.array_contains(signals, name)
    return F.when(has("prohibition") | has("policy"), "invariant").when(has("correction"), "decision").otherwise("convention")


def units(text: Column) -> Column:
    """Clauses: split after sentence ends, at lines, arrows and semicolons."""
    return F.filter(F.transform(F.split(text, UNIT_BREAK), stripped), lambda u: u != "")


def drop_reason(unit: Column, guarded: Column | None = None) -> Column:
    """Name of the first hard rule that drops a clause, or null. guarded: whether the guard finds something
    in it (``guard.findings``); left out, that rule is not applied."""
    fragment = (F.length(unit) < FRAGMENT_CHARS) & matches(unit, FRAGMENT_LEAD) & ~matches(unit, FRAGMENT_VERB)
    return (
        F.when(F.lit(False) if guarded is None else guarded, "guard")
        .when(unit.rlike(MARKDOWN_LINE), "markdown")
        .when(matches(unit, NOT_USER_TEXT) | matches(unit, MACHINE_AUTHORED), "machine-authored")
        .when(unit.rlike(LEADING_QUOTE), "leading-quote")
        .when(matches(unit, NARRATION), "narration")
        .when(matches(unit, META_CONVERSATION), "meta-conversation")
        .when(matches(unit, FIRST_PERSON), "first-person")
        .when(fragment, "verbless-fragment")
    )


def explained(unit: Column, guarded: Column | None = None, threshold: int = THRESHOLD) -> Column:
    """Why a clause would not be proposed: the dropping rule, the first penalty, or below-threshold; else null."""
    penalty = F.filter(capture_signals(unit), lambda n: n.startswith("-"))
    weak = F.when(F.size(penalty) > 0, penalty[0]).otherwise("below-threshold")
    return F.coalesce(drop_reason(unit, guarded), F.when(capture_score(unit) < threshold, weak))


def looks_like_document(text: Column) -> Column:
    """Over 3000 characters, or four lines or more that are not blank with a table or 30 % markdown lines."""
    lines = F.filter(F.split(text, r"\r\n|[\n\r\u000b\u000c\u0085\u2028\u2029]"), lambda x: x.rlike(r"\S"))
    marked = F.size(F.filter(lines, lambda x: x.rlike(MARKDOWN_LINE)))
    furnished = text.rlike(MARKDOWN_TABLE) | (marked / F.size(lines) >= DOCUMENT_SHARE)
    return (F.length(text) > MESSAGE_CHARS) | ((F.size(lines) >= DOCUMENT_LINES) & furnished)


def spoken(text: Column) -> Column:
    """Whether a message is a person talking: no wrapper, command, machine text or document; null is not."""
    said = ~(matches(text, NOT_USER_TEXT) | stripped(text).startswith("/") | matches(text, MACHINE_AUTHORED) | looks_like_document(text))
    return F.coalesce(said & (text != ""), F.lit(False))


def slug(text: Column) -> Column:
    """Lower case, runs of other characters to single dashes, the first 60 characters; ``goal`` if none."""
    plain = F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.when(plain == "", "goal").otherwise(F.substring(plain, 1, 60))


def rendered_line(kind: Column, status: Column, summary: Column, source_ref: Column, source_kind: Column, state: Column) -> Column:
    """The line that shows one atom: kind, summary, source where it is no commit, and a mark if unverifiable."""
    decided = F.concat(F.lit("DECIDED"), F.coalesce(F.concat(F.lit("/"), F.when(status != "", status)), F.lit("")))
    label = F.when(kind == "decision", decided).otherwise(F.upper(F.coalesce(kind, F.lit(""))))
    source = F.when((source_ref != "") & ~source_kind.eqNullSafe(F.lit("commit")), F.concat(F.lit(" _("), source_ref, F.lit(")_")))
    weak = F.when(state == "unverifiable", " _(unverified)_")
    return F.concat(F.lit("- ["), label, F.lit("] "), F.coalesce(summary, F.lit("")), F.coalesce(source, F.lit("")), F.coalesce(weak, F.lit("")))
