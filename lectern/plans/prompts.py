"""What a language model is asked, as columns; each builder says what it wants and in which form."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CUT = "\n\n---\n\n"
LENGTHS = {"short": "Be brief.", "long": "Be thorough.", "auto": "Be as long as the material needs."}
MODES = {
    "comparison": "Set the things compared side by side.", "study_notes": "Write notes to study from.", "exam_prep": "Stress what an exam would ask.", "teaching": "Explain step by step, as to a student.",
    "academic": "Keep a formal tone.", "bullet_points": "Answer in points.", "detailed": "Go into detail.",
}


def _of(names: dict[str, str], key: Column, default: str = "") -> Column:
    out = F.lit(default)
    for name, says in names.items():
        out = F.when(key == name, F.lit(says)).otherwise(out)
    return out


def style(mode: Column, length: Column) -> Column:
    return F.trim(F.concat_ws(" ", _of(MODES, mode), _of(LENGTHS, length, LENGTHS["auto"])))


def excerpts(parts: Column) -> Column:
    return F.array_join(parts, CUT)


def answer(question: Column, parts: Column, said: Column) -> Column:
    return F.concat(F.lit("Answer from the excerpts alone and mark each statement with its page as [p. N]. "), said, F.lit("\n\n"), F.array_join(parts, "\n---\n"), F.lit("\n\nQUESTION: "), question)


def whole(question: Column, focus: Column, parts: Column, said: Column) -> Column:
    return F.concat(F.lit("Explain "), focus, F.lit(" from the excerpts alone, pages marked as [p. N]. "), said, F.lit("\n\n"), F.array_join(parts, "\n---\n"), F.lit("\n\nQUESTION: "), question)


def batch(parts: Column, said: Column) -> Column:
    return F.concat(F.lit("Sum up these excerpts, pages marked as [p. N]. "), said, F.lit("\n\n"), F.array_join(parts, "\n---\n"))


def merge(focus: Column, summaries: Column, said: Column, question: Column | None = None) -> Column:
    end = F.lit("\n\nAn intermediate step.") if question is None else F.concat(F.lit("\n\nREQUEST: "), question)
    return F.concat(F.lit("Put these summaries of "), focus, F.lit(" together, keeping their page marks. "), said, F.lit("\n\n"), F.array_join(summaries, "\n\n"), end)


def overview(parts: Column) -> Column:
    return F.concat(F.lit("List the main topics of this document in a few points.\n\n"), excerpts(parts))


def redirect(question: Column, topics: Column) -> Column:
    return F.concat(F.lit("The document doesn't cover the question. Say so kindly and name what it covers.\n\nQUESTION: "), question, F.lit("\n\nCOVERED:\n"), F.coalesce(topics, F.lit("")))


def guide(focus: Column, material: Column) -> Column:
    kinds = "key_concepts [text], definitions [{term, definition}], formulas [text], faqs [{question, answer}], exam_questions [text], flashcards [{front, back}]"
    return F.concat(F.lit(f"Make a study guide of "), focus, F.lit(f" as JSON: {kinds}. From the material alone.\n\n"), material)


def intent(question: Column, intents: tuple[str, ...], complexities: tuple[str, ...]) -> Column:
    return F.concat(F.lit(f'Classify the question. Answer as JSON: {{"intent": one of {", ".join(intents)}, "complexity": one of {", ".join(complexities)}}}.\n\nQUESTION: '), question)


def relevance(question: Column, passages: Column) -> Column:
    """passages: array of texts, numbered from 0."""
    numbered = F.array_join(F.transform(passages, lambda x, i: F.concat(F.lit("["), i.cast("string"), F.lit("] "), F.substring(x, 1, 500))), "\n\n")
    return F.concat(F.lit('Rate each passage from 0 to 10 by how well it answers the query. Answer as JSON, e.g. {"0": 7, "1": 2}.\n\nQUERY: '), question, F.lit("\n\n"), numbered)
