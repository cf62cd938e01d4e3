"""Text functions: segmentation, markers, words, log lines (F16-F28, P1, P2, W8). All are Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The cue phrases that announce a change of perspective, and the marker families.
SHIFT_CUES = (
    "but|however|wait|hold on|hmm+|oh|actually|alternatively|another (?:idea|approach|way)|on the other hand|no,|"
    "let me reconsider|that'?s (?:not|wrong)"
)
MARKERS = {
    "self_interrupt": r"\b(wait|hold on|hmm+|oh)\b",
    "alternative": r"\b(alternatively|another (?:idea|approach|way)|but what if|on the other hand)\b",
    "contradiction": r"\b(but|however|actually|no,|that'?s (?:not|wrong))\b",
    "question": r"\?",
    "first_person_plural": r"\b(we|us|let'?s|our)\b",
}
DENSITY_MARKERS = r"\b(wait|hmm|but|however|actually|oh|let'?s|no,|alternatively|what if|hold on|recheck|reconsider)\b"
MIN_SEGMENT_CHARS = 40
MIN_SEGMENTS = 3
_CUT = "\u0001"
#: The characters that count as blank at the ends of a text: spaces, tabs, line ends and their Unicode kin.
BLANKS = "".join(c for c in map(chr, range(0x3001)) if c.isspace())


def stripped(text: Column) -> Column:
    """The text without blanks at its ends, line ends among them (trim alone takes spaces)."""
    return F.btrim(text, F.lit(BLANKS))


def right_stripped(text: Column) -> Column:
    return F.rtrim(text, F.lit(BLANKS))


def segments(text: Column, cues: str = SHIFT_CUES, min_chars: int = MIN_SEGMENT_CHARS, boundary: str = r"\b") -> Column:
    """pieces of a trace between cues, trimmed; short pieces are dropped. A cue counts at the start
    or behind . ! ? or a line end. A trace without one is a single piece if it is long enough.

    A trailing comma in a cue needs a word character behind it ("no,that" is a cue, "no, that" isn't).
    """
    marked = F.regexp_replace(text, rf"(?i)(^|[.!?\n])(\s*(?:{cues}){boundary})", f"$1{_CUT}$2")
    pieces = F.transform(F.split(marked, _CUT), lambda s: F.regexp_replace(s, r"(?U)^\s+|\s+$", ""))
    whole = F.when(F.length(text) >= min_chars, F.array(text)).otherwise(F.array().cast("array<string>"))
    return F.when(marked.contains(_CUT), F.filter(pieces, lambda s: F.length(s) >= min_chars)).otherwise(whole)


def word_count(text: Column) -> Column:
    """words between blanks, Unicode blanks included."""
    return F.coalesce(F.regexp_count(text, F.lit(r"(?U)\S+")), F.lit(0))


def marker_counts(text: Column, markers: dict[str, str] = MARKERS) -> Column:
    """a map from marker family to its number of matches."""
    return F.create_map(*[x for k, p in markers.items() for x in (F.lit(k), F.regexp_count(text, F.lit(f"(?i){p}")))])


def marker_rate(text: Column, pattern: str = DENSITY_MARKERS) -> Column:
    """markers a word."""
    return F.regexp_count(text, F.lit(f"(?i){pattern}")) / F.greatest(word_count(text), F.lit(1))


def lexicon_score(text: Column, lexicon: list[str]) -> Column:
    """distinct lexicon words over the square root of the distinct words."""
    words = F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"([a-z\-']+)"), 1))
    hits = F.size(F.array_intersect(words, F.array(*[F.lit(w) for w in sorted(set(lexicon))])))
    return hits / F.sqrt(F.greatest(F.size(words), F.lit(1)))


def last_match(text: Column, pattern: str, group: int = 1) -> Column:
    """The last match in the text, else null."""
    return F.try_element_at(F.regexp_extract_all(text, F.lit(pattern), group), F.lit(-1))


def first_match(text: Column, pattern: str, group: int = 1) -> Column:
    """The first match, else null (regexp_extract alone can't tell an empty match from none)."""
    return F.when(F.regexp_like(text, F.lit(pattern)), F.regexp_extract(text, pattern, group))


def final_answer(text: Column) -> Column:
    """the last flat boxed payload, else the last line that isn't blank, else empty."""
    lines = F.filter(F.transform(F.split(text, r"\r\n|\r|\n"), lambda v: stripped(v)), lambda x: F.length(x) > 0)
    return F.coalesce(stripped(last_match(text, r"\\boxed\{([^{}]*)\}")), F.try_element_at(lines, F.lit(-1)), F.lit(""))


def without_code_fences(text: Column) -> Column:
    """F27"""
    return stripped(F.regexp_replace(text, r"(?m)^```[A-Za-z]*\s*$", ""))


# Fixed value: terminal colours in logs.
_COLOUR = r"\x1b\[[0-9;]*m"


# How a log writes a metric and its step.
_METRIC = r"([A-Za-z_][\w/.\-]*):(-?\d+(?:\.\d+)?(?:[eE][-+]?\d+)?)\b"
_STEP = r"\bstep:(\d+)\b"


def bound(value: Column, use) -> Column:
    """use(value), with the value computed once however often it is used."""
    return F.transform(F.array(value), use)[0]


def metric_line(line: Column) -> Column:
    """struct<step, metrics map> of a training-log line; null if it names no step or no metric.
    Of a metric that a line names twice the last counts."""
    name = lambda t: F.substring_index(t, ":", 1)

    def point(tokens: Column, keys: Column, step: Column) -> Column:
        # last ones first: of a name the first place counts
        some = F.filter(tokens, lambda t, i: (F.array_position(keys, name(t)) == i + 1) & (name(t) != "step"))
        return bound(some, lambda s: F.when(step.isNotNull() & (F.size(s) > 0), F.struct(
            step.alias("step"), F.map_from_arrays(F.transform(s, name), F.transform(s, lambda t: F.substring_index(t, ":", -1).cast("double"))).alias("metrics"),
        )))

    clean = F.regexp_replace(F.regexp_replace(line, _COLOUR, ""), "\r", "")
    found = lambda c: F.reverse(F.regexp_extract_all(c, F.lit(_METRIC), F.lit(0)))
    return bound(clean, lambda c: bound(found(c), lambda tokens: point(tokens, F.transform(tokens, name), first_match(c, _STEP).cast("bigint"))))


# The worker prefixes below are fixed values, as the logs write them.
def log_traces(log: Column) -> Column:
    """The traces of a whole log in file order, without colours and worker prefixes."""
    clean = F.regexp_replace(F.regexp_replace(log, r"\x1b\[\d+m", ""), r"\((?:main_task|WorkerDict) pid=\d+\)", "")
    return F.regexp_extract_all(clean, F.lit(r"(?s)(<think>.*?</answer>)"), 1)


def number_list(nums: Column) -> Column:
    """[a, b, c] as in the prompts."""
    return F.concat(F.lit("["), F.array_join(nums.cast("array<string>"), ", "), F.lit("]"))


def prompt(template: str, **fields: Column) -> Column:
    """A template with {field} places, filled from columns; doubled braces stand for themselves."""
    import string

    parts = []
    for text, field, _, _ in string.Formatter().parse(template):
        if text:
            parts.append(F.lit(text))
        if field is not None:
            parts.append(fields[field].cast("string"))
    return F.concat(*parts)


# Fixed value: the number-puzzle prompt.
COUNTDOWN_PROMPT = (
    "Using the numbers {numbers}, create an equation that equals {target}. You can use basic arithmetic operations "
    "(+, -, *, /) and each number can only be used once. Show your work in <think> </think> tags. And return the final "
    "answer in <answer> </answer> tags, for example <answer> (1 + 2) / 3 </answer>."
)


def choices(options: Column) -> Column:
    """One lettered line for each option."""
    lettered = F.transform(options, lambda o, i: F.concat(F.lit("("), F.char(i + 65), F.lit(") "), o))
    return F.array_join(lettered, "\n")


# What frames the voices of a dialogue, and the containers of its outcome.
_FRAMES = r"(?is)<!--.*?-->|<cast_of_characters>.*?</cast_of_characters>|<persona\d+>.*?</persona\d+>|</?conversation>|</?think\d+>"
_OUTCOME = r"(?i)<(?:group_solution|group_consensus|answer)>"


def one_think_block(trace: Column) -> Column:
    """a dialogue of personas as one reasoning block, the answer container left behind it."""
    voices = F.regexp_replace(trace, _FRAMES, " ")
    # the outcome begins where the text in front of its first container ends
    reasoning = F.split(voices, _OUTCOME, 2)[0]
    outcome = F.substring(voices, F.length(reasoning) + 1, F.length(voices))
    block = F.array_join(F.array(F.lit("<think>"), stripped(F.regexp_replace(reasoning, r"(?U)\s+", " ")), F.lit("</think>")), " ")
    return right_stripped(F.concat(block, F.lit("\n"), stripped(outcome)))


# The group tags below are fixed values, as the traces write them.
def with_answer_container(text: Column) -> Column:
    """a group container is repeated as an answer at the end, unless there is an answer."""
    group = r"(?is)(<group_(?:consensus|solution)>.*?</group_(?:consensus|solution)>)"
    inner = stripped(F.regexp_replace(F.regexp_extract(text, group, 1), r"(?i)</?group_(?:consensus|solution)>", ""))
    add = ~F.regexp_like(text, F.lit(r"(?is)<answer>.*?</answer>")) & F.regexp_like(text, F.lit(group))
    return F.when(add, F.concat(text, F.lit("\n<answer>"), inner, F.lit("</answer>"))).otherwise(text)


def response_target(trace: Column) -> Column:
    """a gradable training target: container normalised, nothing behind the last closing answer tag."""
    norm = with_answer_container(stripped(trace))
    return right_stripped(F.coalesce(first_match(norm, r"(?is)^(.*</answer>)"), norm))


def dialogue_answer(text: Column) -> Column:
    """F16: the first group solution."""
    return stripped(first_match(text, r"(?is)<group_(?:consensus|solution)>(.*?)</group_(?:consensus|solution)>"))


# The lead-in below is a fixed value, as answers are introduced.
def monologue_answer(text: Column) -> Column:
    """F16: the first line behind the first reasoning block, without its prefix."""
    tail = stripped(F.regexp_extract(text, r"(?is)<think>.*?</think>\s*(.*)$", 1))
    bare = F.regexp_replace(tail, r"(?i)^(the\s+)?(final\s+)?answer\s*(is)?\s*[:\-]?\s*", "")
    line = stripped(F.element_at(F.split(bare, "\n"), 1))
    return F.when(F.regexp_like(text, F.lit(r"(?is)<think>.*?</think>")) & (F.length(line) > 0), line)


def well_formed_dialogue(text: Column) -> Column:
    """P10: cast tags as they are, two numbered thinkers and a group solution."""
    return (
        text.contains("<cast_of_characters>")
        & text.contains("</cast_of_characters>")
        & F.regexp_like(text, F.lit(r"(?i)<think1>"))
        & F.regexp_like(text, F.lit(r"(?i)<think2>"))
        & dialogue_answer(text).isNotNull()
    )


def masked_labels(ids: Column, prompt_length: Column, most: int, end_id: int) -> Column:
    """token labels with the prompt masked by -100; the end id is appended, then all is cut to `most`."""
    full = F.slice(F.concat(ids, F.array(F.lit(end_id))), 1, most)
    return F.transform(full, lambda x, i: F.when(i < prompt_length, F.lit(-100)).otherwise(x))
