"""Marks put into a text while it is assembled from events.

All are Unicode noncharacters, which valid text never holds; the parser drops
them from pages.
"""

HEADING, HEADING_END = "\ufdd2", "\ufdd3"  # heading within a link
PARA, LINE, ROW = "\ufdd4", "\ufdd5", "\ufdd6"  # pending blank line, line, table row end
GLUE = "\ufdd7"  # what is pending before this is dropped
START = "\ufdd8"  # what is pending after this is dropped
BREAK = "\ufdd9"  # hard line break
CODE, CODE_END = "\ufdda", "\ufddb"  # number of a code block
QUOTE, QUOTE_END = "\ufddc", "\ufddd"  # quote depth from here on
SPACE = "\ufdde"  # blank that does not collapse
