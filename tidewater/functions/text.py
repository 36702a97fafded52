"""Text normalisers, answer extractors and prompt templates as Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Prefixes that are cut from an answer, in the order they are cut (two of them are pairs run together).
ANSWER_PREFIXES = [
    "The best answer is",
    "The correct answer is",
    "The answer is",
    "The answer",
    "The best option isThe correct option is",
    "Best answer:Best option:",
    "Answer:",
    "Option:",
    "The correct answer",
    "The correct option",
]
#: Words that stand for yes and no.
YES, NO = ["yes", "y", "true", "t", "1"], ["no", "n", "false", "f", "0"]
#: Fixed value: punctuation around a yes or no.
_MARKS = " .,!?:;()[]{}\"'`“”’•-_"


def strip_option_prefix(options: Column) -> Column:
    """'A. x' to 'x': what follows the first '. '; without one the option stays."""
    return F.transform(options, lambda x: F.when(F.instr(x, ". ") > 0, F.substr(x, F.instr(x, ". ") + 2)).otherwise(x))


def add_option_prefix(options: Column) -> Column:
    return F.transform(options, lambda x, i: F.concat(F.char(F.lit(65) + i), F.lit(". "), x))


def after_colon_paren(c: Column) -> Column:
    """Text after the first '):', or the text."""
    return F.when(F.instr(c, "):") > 0, F.substr(c, F.instr(c, "):") + 2)).otherwise(c)


def letter_to_text(choices: Column, letter: Column) -> Column:
    """The choice of a letter, '' if there is none."""
    k = F.ascii(letter) - 65
    return F.coalesce(F.when((k >= 0) & (k < F.size(choices)), F.get(choices, k)), F.lit(""))


def text_to_letter(choices: Column, answer: Column) -> Column:
    """The letter of a choice, null if there is none."""
    k = F.array_position(choices, answer)
    return F.when(k > 0, F.char(F.lit(64) + k.cast("int")))


def extract_choice(c: Column) -> Column:
    """The character before the first ')', else the first one; '' for ')' at the start; null for an empty answer."""
    at = F.instr(c, ")")
    return F.when(F.length(c) == 0, F.lit(None)).when(at > 1, F.substr(c, at - 1, F.lit(1))).when(at == 1, "").otherwise(F.substring(c, 1, 1))


def extract_option_letter(c: Column) -> Column:
    """First of A-D after known prefixes are cut; '' without one."""
    s = F.trim(c)
    for p in ANSWER_PREFIXES:
        s = F.replace(s, F.lit(p), F.lit(""))
    return F.regexp_extract(s, "[ABCD]", 0)


def typed_answer(choices: Column, answer: Column) -> Column:
    """Lower case for yes/no choices, trimmed for all-digit choices, else the extracted choice."""
    yes_no = F.forall(choices, lambda x: F.lower(x).isin("yes", "no"))
    digits = F.forall(choices, lambda x: x.rlike(r"^\d+$"))
    return F.when(yes_no, F.lower(F.trim(answer))).when(digits, F.trim(answer)).otherwise(extract_choice(answer))


def _binary(c: Column) -> Column:
    return (
        F.when(c.isin(YES), "yes").when(c.isin(NO), "no").when(c.startswith("yes"), "yes").when(c.startswith("no"), "no")
    )


def normalize_binary(c: Column) -> Column:
    """yes, no, or the answer in lower case; null to ''."""
    s = F.lower(F.trim(c))
    bare = F.btrim(s, F.lit(_MARKS))
    return F.coalesce(_binary(s), _binary(bare), s, F.lit(""))


def squash(c: Column) -> Column:
    """Trimmed, lower case, runs of white space to one space."""
    return F.lower(F.trim(F.regexp_replace(c, r"\s+", " ")))


def basename(c: Column) -> Column:
    return F.substring_index(c, "/", -1)


def stem(c: Column) -> Column:
    """Base name up to its first dot."""
    return F.substring_index(basename(c), ".", 1)


def first_text(*cs: Column) -> Column:
    return F.coalesce(*cs)


def path_rebase(c: Column, old: str, new: str) -> Column:
    return F.when(c.startswith(old), F.concat(F.lit(new), F.substring(c, len(old) + 1, 1 << 30))).otherwise(c)


def drop_repeats(c: Column) -> Column:
    """Words in order without those seen before; stops where a word repeats the last one kept."""
    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit(False).alias("stop"))

    def step(a, w):
        last = F.when(F.size(a["out"]) > 0, F.element_at(a["out"], -1))
        seen = F.array_contains(a["out"], w)
        return (
            F.when(a["stop"], a)
            .when(~seen, F.struct(F.array_append(a["out"], w).alias("out"), F.lit(False).alias("stop")))
            .otherwise(F.struct(a["out"].alias("out"), (w == last).alias("stop")))
        )

    return F.array_join(F.aggregate(F.split(c, " "), start, step, lambda a: a["out"]), " ")


def fenced_json(c: Column) -> Column:
    """What stands between ```json and the next ```."""
    return F.trim(F.regexp_extract(c, r"(?s)```json(.*?)```", 1))


def literal_to_json(c: Column) -> Column:
    """A Python literal as JSON text: quotes and the names of constants."""
    s = F.replace(c, F.lit("'"), F.lit('"'))
    for a, b in (("None", "null"), ("True", "true"), ("False", "false"), ("nan", "null")):
        s = F.regexp_replace(s, rf"\b{a}\b", b)
    return s


def pad_to(c: Column, n: int, filler: Column) -> Column:
    return F.slice(F.concat(c, F.array_repeat(filler, n)), 1, n)


def pad_last(c: Column, m: int) -> Column:
    """Repeat the last element up to a multiple of ``m``."""
    missing = F.pmod(-F.size(c), F.lit(m))
    return F.when(F.size(c) > 0, F.concat(c, F.array_repeat(F.element_at(c, -1), missing))).otherwise(c)


def join_streamed(parts: Column) -> Column:
    """Parts without their trailing ' ...', empty ones left out, joined and closed with '...'."""
    cut = F.filter(F.transform(parts, lambda x: F.trim(F.replace(x, F.lit(" ..."), F.lit("")))), lambda x: F.length(x) > 0)
    return F.concat(F.array_join(cut, " "), F.lit("..."))


def keep_separators(c: Column, words: list[str]) -> Column:
    """Split before and after each keyword, which stays as a part; empty parts go."""
    w = "|".join(rf"\Q{x}\E" for x in words)
    return F.filter(F.split(c, rf"(?={w})|(?<={w})"), lambda x: F.length(x) > 0)


def yes_no_or_lettered(options: Column) -> Column:
    """Yes and No in the order of their lower-case forms, if these are the two options; else options with letters."""
    pair = (F.size(options) == 2) & F.array_contains(options, "yes") & F.array_contains(options, "no")
    ordered = F.when(F.lower(F.element_at(options, 1)) == "no", F.array(F.lit("No"), F.lit("Yes"))).otherwise(F.array(F.lit("Yes"), F.lit("No")))
    return F.when(pair, ordered).otherwise(add_option_prefix(options))


def yes_no_or_letter(options: Column, k: Column) -> Column:
    """The right answer to ``yes_no_or_lettered`` options: the option itself, or its letter."""
    pair = (F.size(options) == 2) & F.array_contains(options, "yes") & F.array_contains(options, "no")
    return F.when(pair, F.get(yes_no_or_lettered(options), k)).otherwise(F.char(F.lit(65) + k))


def parsed_object(c: Column, schema: str) -> Column:
    """JSON, else a Python literal, else an empty object."""
    whole = lambda x: F.when(F.try_parse_json(x).isNotNull(), F.from_json(x, schema))
    return F.coalesce(whole(c), whole(literal_to_json(c)), F.from_json(F.lit("{}"), schema))


#: Wordings of the questions that depend on their task; {} is the step, question or activity.
TASK_QUESTIONS = {
    "SSR": """You're watching a tutorial video which contain a sequential of steps.
The following is one step from the whole procedures:
{}
Your task is to decide: Is the man/woman in the video currently carrying out this step?
Return "Yes" if the man/woman in the video is currently performing this step;
Return "No" if not.""",
    "CRR": """You're responsible of answering questions based on the video content.
The following question are relevant to the latest frames, i.e. the end of the video.
{}
Decide whether existing visual content, especially latest frames, i.e. frames that near the end of the video, provide enough information for answering the question.
Answer only with “Yes” or “No”.
Do not include any additional text or explanation in your response.""",
    "REC": """You're watching a video in which people may perform a certain type of action repetively.
The person performing this kind of action are referred to as 'they' in the following statement.
You're task is to count how many times have different people in the video perform this kind of action in total.
One complete motion counts as one. 
Now, answer the following question: {}
Provide your answer as a single number (e.g., 0, 1, 2, 3…) indicating the total count.
Do not include any additional text or explanation in your response.""",
}


def task_question(task: Column, subject: Column) -> Column:
    """The question that a task asks about a subject; other tasks ask the subject itself."""
    out = subject
    for name, wording in TASK_QUESTIONS.items():
        before, after = wording.split("{}")
        out = F.when(task == name, F.concat(F.lit(before), subject, F.lit(after))).otherwise(out)
    return out


def task_answer(task: Column, kind: Column, count: Column, options: Column, k: Column) -> Column:
    """Yes or No by ``kind`` for SSR and CRR, the count for REC, else the option at ``k``."""
    return F.when(task.isin("SSR", "CRR"), F.when(kind == 1, "Yes").otherwise("No")).when(task == "REC", count.cast("string")).otherwise(F.get(options, k))


def flattened(schema, sep: str = "/", prefix: str = "", path: Column | None = None) -> list[Column]:
    """Leaf columns of nested structs, named by their path."""
    from pyspark.sql import types as T

    out = []
    for f in schema.fields:
        if sep in f.name:
            raise ValueError(f"separator {sep!r} in the name {f.name!r}")
        c = F.col(f"`{f.name}`") if path is None else path[f.name]
        if isinstance(f.dataType, T.StructType):
            out += flattened(f.dataType, sep, f"{prefix}{f.name}{sep}", c)
        else:
            out.append(c.alias(prefix + f.name))
    return out


def scalars(c: Column) -> Column:
    """The element of a one-element array; null for others."""
    return F.when(F.size(c) == 1, F.element_at(c, 1))


# prompts; the wordings in these builders are fixed values


def prompt_default(question: Column, choices: Column) -> Column:
    return F.concat(F.lit("Question: "), question, F.lit("\nOptions:\n"), F.array_join(F.transform(choices, lambda x, i: F.concat(F.lit("("), F.char(F.lit(65) + i), F.lit(") "), x)), "\n"), F.lit("\nOnly give the best option."))


def prompt_compact(question: Column, choices: Column) -> Column:
    return F.concat(question, F.lit("\n"), F.array_join(add_option_prefix(choices), "\n"))


#: Wording of the instruction-rich prompt.
INSTRUCTION = "Please carefully analyze the video and select the best answer from the options below."


def prompt_instruction(question: Column, choices: Column) -> Column:
    lines = F.array_join(F.transform(choices, lambda x, i: F.concat(F.lit("("), F.char(F.lit(65) + i), F.lit(") "), x)), "\n")
    return F.concat(F.lit(f"{INSTRUCTION}\n\nQuestion: "), question, F.lit("\n\nOptions:\n"), lines, F.lit("\n\nPlease provide your answer as a single letter (A, B, C, or D)."))


def prompt_numbered(question: Column, choices: Column) -> Column:
    lines = F.array_join(F.transform(choices, lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x)), "\n")
    return F.concat(F.lit("Question: "), question, F.lit("\nOptions:\n"), lines, F.lit("\nAnswer with the option number (1, 2, 3, or 4)."))


def prompt_streaming(question: Column, choices: Column) -> Column:
    """Options get letters unless they have them; without options the prompt asks for an open answer."""
    lettered = F.when(F.element_at(choices, 1).startswith("A."), choices).otherwise(add_option_prefix(choices))
    closed = F.concat(question, F.lit("\n"), F.array_join(lettered, "\n"), F.lit("\n\nOnly give the best option."))
    return F.when(F.size(choices) > 0, closed).otherwise(F.concat(question, F.lit("\n\nAnswer:")))


PROMPTS = {
    "default": prompt_default,
    "streaming": prompt_streaming,
    "compact": prompt_compact,
    "instruction_rich": prompt_instruction,
    "numbered": prompt_numbered,
}


def context_text(title: Column, previous: Column) -> Column:
    """Title and previous text, or the one there is."""
    return F.trim(F.concat_ws("\n", F.when(F.trim(title) != "", title), F.when(F.trim(previous) != "", previous)))


def is_letter_answer(c: Column, letters: str = "ABCD") -> Column:
    return F.coalesce(F.substring(c, 1, 1).isin(list(letters)), F.lit(False))
