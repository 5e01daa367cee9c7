"""Stemmers as Arrow-batched Column functions, by language.

At corpus scale stem the distinct words and join back; the functions remember words within a batch.
"""

from sparklex.functions.phonetics import word_udf
from sparklex.functions.stemming.english import english, porter
from sparklex.functions.stemming.french import french
from sparklex.functions.stemming.german import german
from sparklex.functions.stemming.romance import italian, portuguese, spanish

STEMMERS = {"porter": porter, "en": english, "fr": french, "de": german, "es": spanish, "it": italian, "pt": portuguese}


def stem(column, language: str):
    """The stems of a string column; null in, null out."""
    return word_udf(STEMMERS[language])(column)
