"""Prompts for rewriting a chunk (own wording)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import languages, text
from .columns import first_case

RULES = (
    "You edit the transcript of a lecture. Keep every statement, example, number and name. Mend punctuation, "
    "spelling and broken words, drop fillers and repeats, and set the text in paragraphs with Markdown headings where a topic begins. "
    "Do not translate, sum up, explain or add anything. Answer with the edited text only."
)
#: What is added for languages in Arabic script.
ARABIC_RULE = " Keep the speaker's Arabic, dialect words included, and leave English terms as they are."
#: What a second attempt is told, by the reason why the first was refused.
AGAIN = {
    "translated": "Your last answer changed the language. Write in the language of the source.",
    "too_short": "Your last answer left things out. Keep every sentence.",
    "too_long": "Your last answer added things. Say only what the source says.",
    "failed": "Your last answer was empty. Give the edited text.",
}


def system(language: Column) -> Column:
    code = languages.normalized(language)
    said = F.coalesce(F.concat(F.lit(" The lecture is in "), languages.name_of(language), F.lit(".")), F.lit(""))
    return F.concat(F.lit(RULES), said, F.when(code.isin(*languages.ARABIC_SCRIPT), ARABIC_RULE).otherwise(F.lit("")))


def user(chunk: Column) -> Column:
    """A chunk with its number of words, by which the answer's length is judged."""
    return F.concat(F.lit("The source has "), text.n_tokens(chunk).cast("string"), F.lit(" words:\n\n"), F.coalesce(chunk, F.lit("")))


def again(chunk: Column, reason: Column) -> Column:
    """The prompt of the second, stricter attempt."""
    told = first_case([(reason == r, F.lit(words)) for r, words in AGAIN.items()], F.lit("Your last answer could not be used."))
    return F.concat(told, F.lit(" "), user(chunk))
