"""Text clean-up as Column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: ASCII punctuation, and accented letters with their plain forms.
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
ACCENTED = "áàâäãåéèêëíìîïóòôöõúùûüçñÁÀÂÄÃÅÉÈÊËÍÌÎÏÓÒÔÖÕÚÙÛÜÇÑ"
PLAIN = "aaaaaaeeeeiiiiooooouuuucnAAAAAAEEEEIIIIOOOOOUUUUCN"


def clean(text: Column, stop_words: tuple[str, ...] = (), full: bool = True) -> Column:
    """Without punctuation; if ``full`` also without accents, lower-cased and without stop words. Null gives null."""
    bare = F.translate(text, PUNCTUATION, "")
    if not full:
        return bare
    lowered = F.lower(F.translate(bare, ACCENTED + "\t\n\r", PLAIN + "   "))
    words = F.array_remove(F.split(lowered, " "), "")
    if stop_words:
        words = F.filter(words, lambda w: ~w.isin(*stop_words))
    return F.array_join(words, " ")
