"""Messages for, and answers from, a chat model."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from textfix.functions.text import WS, let, strip

# The instruction sent with every text, and the shapes removed from an answer.
SYSTEM_PROMPT = (
    "You are a precise writing assistant. Correct only the spelling, grammar, and punctuation of "
    "the user's sentence. Do not rephrase, reword, summarize, or change the meaning, and preserve "
    "the original wording as much as possible. Output only the corrected sentence, with no "
    "quotation marks, no preamble, and no explanation."
)
THINK_RE = r"(?s)<think>.*?</think>"
LABEL_RE = rf"(?i)^(corrected sentence|correction|corrected|answer|output)[{WS}]*[:\-][{WS}]*"
LINE_BREAK_RE = r"\r\n|[\n-\r\x1c-\x1e\x{85}\x{2028}\x{2029}]"
OPEN_QUOTES = "\"'“‘"
CLOSE_QUOTES = "\"'”’"


def chat_messages(text: Column, system_prompt: str = SYSTEM_PROMPT) -> Column:
    def message(role: str, content: Column) -> Column:
        return F.struct(F.lit(role).alias("role"), content.alias("content"))

    return F.array(message("system", F.lit(system_prompt)), message("user", text))


def clean_completion(completion: Column) -> Column:
    """First useful line of an answer, without thoughts, label or one pair of quotes."""

    def unquote(line: Column) -> Column:
        quoted = (
            (F.length(line) >= 2)
            & F.lit(OPEN_QUOTES).contains(F.left(line, F.lit(1)))
            & F.lit(CLOSE_QUOTES).contains(F.right(line, F.lit(1)))
        )
        return F.when(quoted, strip(F.substr(line, F.lit(2), F.length(line) - 2))).otherwise(line)

    lines = F.transform(F.split(F.regexp_replace(completion, THINK_RE, ""), LINE_BREAK_RE, -1), strip)
    first = F.coalesce(F.get(F.filter(lines, lambda s: s != ""), F.lit(0)), F.lit(""))
    return F.when(
        completion.isNotNull(), let(strip(F.regexp_replace(first, LABEL_RE, "")), unquote)
    )
