"""Operator 9: the main text of web pages, from flat text blocks and a decision tree."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

# Element names of HTML.
BLOCK_TAGS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav noscript ol optgroup option p pre search section summary table tbody td template tfoot th thead title tr ul".split()
)
HIDDEN_TAGS = frozenset("script style template noscript head title svg math iframe object canvas audio video textarea select button noframes".split())
HEAD_TAGS = frozenset("html head title base link meta style script noscript template".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
AROUND_TAGS = frozenset("nav header footer aside menu dialog search".split())
INSIDE_TAGS = frozenset("article main".split())
#: Elements that are text by themselves: their names tell of what they quote, not of a part of the page.
QUOTE_TAGS = frozenset("blockquote q pre code cite".split())
#: Words of class, id and role that tell what a part of a page is.
AROUND_NAMES = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|sponsor\w*|promo\w*|banner|cookies?|consent|gdpr|notices?|notification|alert|popup|modal|overlay|nav\w*|menus?|breadcrumbs?|sidebars?|aside|widgets?|footer|header|masthead|topbar|toolbar|social|share\w*|related|recommend\w*|newsletter|subscri\w*|signup|login|search\w*|pagination|pager|tags?|comments?|comment-?list|replies|reply|respond|disqus|discussion|hidden|skip|complementary|contentinfo|copyright|legal|disclaimer)(?=$|[\s_-])",
    re.IGNORECASE,
)
INSIDE_NAMES = re.compile(r"(?:^|[\s_-])(?:article\w*|main|content|entry|post|story|body|text)(?=$|[\s_-])", re.IGNORECASE)
#: Class names that say what an element has, lacks or is about, not what it is.
ASIDE_NAMES = re.compile(r"(?i)(?:has|have|with|no|not|without|is|show|hide|tag|category|format|status|type)-.*|.*-(?:fixed|sticky|open|opened|closed|visible|enabled|disabled|active|collapsed|loaded)")
READERS = re.compile(r"(?i)(?:^|[\s_-])(?:comments?|reply|replies|teasers?|related|cards?)(?=$|[\s_-])")
SPACES = re.compile(r"\s+")

#: What the tree sees of a block: its words and link density, those of the blocks before and after, and its place:
#: in a part around the text (menu, footer, ...); in an article (2) or in a part that is named like one (1); or
#: beside the article that the page marks.
FEATURES = ("words", "links", "words_before", "links_before", "words_after", "links_after", "around", "inside", "beside", "item", "heading")
#: The order in which the tree tries them; of equally good splits the first is taken: densities, then sizes, then place.
ORDER = (1, 3, 5, 0, 2, 4, 6, 7, 8, 9, 10)

# A small labelled table, as seen on common pages: (FEATURES..., 1 if main text).
LABELLED = (
    # paragraphs of an article
    (80, 0.0, 60, 0.0, 70, 0.0, 0, 2, 0, 0, 0, 1), (45, 0.1, 9, 0.0, 70, 0.0, 0, 2, 0, 0, 0, 1), (3, 0.0, 80, 0.0, 66, 0.0, 0, 2, 0, 0, 0, 1),
    (1, 0.0, 1, 0.0, 90, 0.1, 0, 2, 0, 0, 0, 1), (1, 0.0, 30, 0.0, 12, 0.0, 0, 2, 0, 0, 0, 1), (12, 1.0, 55, 0.0, 61, 0.0, 0, 2, 0, 0, 0, 1),
    (2, 0.5, 40, 0.0, 33, 0.0, 0, 2, 0, 0, 0, 1), (4, 1.0, 3, 1.0, 2, 1.0, 0, 2, 0, 1, 0, 1), (20, 0.9, 2, 0.0, 8, 0.0, 0, 2, 0, 0, 0, 1), (3, 1.0, 5, 0.0, 6, 0.0, 0, 2, 0, 0, 0, 1), (9, 0.0, 0, 0.0, 0, 0.0, 0, 2, 0, 0, 0, 1), (25, 0.2, 6, 1.0, 7, 1.0, 0, 2, 0, 0, 0, 1),
    # in an article lists of links are its sources and contents
    (4, 1.0, 60, 0.0, 3, 1.0, 0, 2, 0, 1, 0, 1), (2, 1.0, 3, 1.0, 4, 1.0, 0, 2, 0, 1, 0, 1), (6, 1.0, 5, 1.0, 41, 0.0, 0, 2, 0, 1, 0, 1),
    (9, 1.0, 12, 0.9, 8, 1.0, 0, 2, 0, 0, 0, 1), (3, 0.8, 70, 0.0, 5, 1.0, 0, 2, 0, 0, 0, 1), (5, 0.0, 6, 1.0, 7, 1.0, 0, 2, 0, 0, 1, 1),
    (7, 1.0, 80, 0.1, 0, 0.0, 0, 2, 0, 0, 0, 1), (1, 1.0, 2, 1.0, 1, 1.0, 0, 2, 0, 1, 0, 1), (3, 1.0, 4, 1.0, 90, 0.0, 0, 2, 0, 0, 0, 1),
    (5, 1.0, 44, 0.0, 2, 1.0, 0, 2, 0, 1, 0, 1), (3, 1.0, 20, 0.0, 6, 1.0, 0, 2, 0, 1, 0, 1), (2, 1.0, 35, 0.0, 1, 1.0, 0, 2, 0, 0, 0, 1),
    (30, 0.0, 3, 0.0, 2, 1.0, 0, 2, 0, 0, 0, 1), (12, 0.1, 2, 0.0, 6, 1.0, 0, 2, 0, 0, 0, 1), (4, 0.0, 1, 0.0, 3, 1.0, 0, 2, 0, 0, 0, 1),
    (8, 0.0, 4, 1.0, 9, 1.0, 0, 2, 0, 0, 0, 1), (2, 0.0, 2, 0.0, 1, 1.0, 0, 2, 0, 1, 0, 1), (5, 0.0, 0, 0.0, 4, 1.0, 0, 2, 0, 0, 1, 1),
    (1, 0.0, 1, 1.0, 40, 0.0, 0, 2, 0, 0, 1, 1), (6, 0.0, 2, 1.0, 30, 0.0, 0, 2, 0, 0, 1, 1), (3, 0.0, 1, 1.0, 12, 0.0, 0, 2, 0, 0, 0, 1),
    (5, 0.0, 1, 1.0, 5, 0.0, 0, 2, 0, 0, 0, 1), (2, 0.0, 3, 1.0, 0, 0.0, 0, 2, 0, 0, 0, 1), (4, 0.0, 2, 0.8, 8, 1.0, 0, 2, 0, 1, 0, 1),
    (3, 0.0, 4, 1.0, 2, 1.0, 0, 2, 0, 0, 0, 1), (6, 0.0, 8, 0.9, 5, 1.0, 0, 2, 0, 0, 1, 1), (2, 0.0, 1, 1.0, 3, 1.0, 0, 2, 0, 1, 0, 1), (7, 0.1, 5, 1.0, 4, 0.8, 0, 2, 0, 0, 0, 1),
    # its headings and lists
    (7, 0.0, 8, 1.0, 60, 0.0, 0, 2, 0, 0, 1, 1), (5, 0.0, 60, 0.0, 44, 0.0, 0, 2, 0, 0, 1, 1), (9, 1.0, 12, 0.0, 75, 0.0, 0, 2, 0, 0, 1, 1),
    (6, 0.0, 20, 0.0, 5, 0.0, 0, 2, 0, 1, 0, 1), (14, 0.3, 7, 0.0, 11, 0.0, 0, 2, 0, 1, 0, 1), (2, 0.0, 3, 0.0, 2, 0.0, 0, 2, 0, 1, 0, 1),
    # menus, headers, footers, sidebars, notices, adverts, forms, comments
    (1, 1.0, 1, 1.0, 1, 1.0, 1, 0, 0, 1, 0, 0), (2, 1.0, 0, 0.0, 2, 1.0, 1, 0, 0, 1, 0, 0), (8, 0.0, 1, 1.0, 7, 0.0, 1, 0, 0, 0, 0, 0),
    (40, 0.0, 60, 0.0, 6, 0.0, 1, 0, 0, 0, 0, 0), (90, 0.0, 50, 0.0, 0, 0.0, 1, 0, 0, 0, 0, 0), (12, 0.4, 9, 0.0, 0, 0.0, 1, 0, 0, 0, 0, 0),
    (15, 0.0, 70, 0.0, 55, 0.0, 1, 2, 0, 0, 0, 0), (30, 0.0, 64, 0.0, 20, 0.1, 1, 2, 0, 0, 0, 0), (2, 1.0, 88, 0.0, 2, 1.0, 1, 2, 0, 1, 0, 0),
    (6, 0.0, 2, 1.0, 7, 0.0, 1, 0, 0, 0, 1, 0), (4, 0.0, 81, 0.0, 30, 0.1, 1, 2, 0, 0, 1, 0), (33, 0.1, 5, 0.0, 41, 0.0, 1, 0, 0, 0, 0, 0),
    (1, 1.0, 1, 1.0, 1, 1.0, 1, 0, 0, 1, 0, 0), (10, 0.0, 1, 1.0, 60, 0.0, 1, 0, 0, 0, 0, 0), (70, 0.0, 44, 0.0, 38, 0.0, 1, 0, 0, 0, 0, 0),
    # what stands beside an article that the page marks
    (9, 0.0, 1, 1.0, 8, 0.0, 0, 0, 1, 0, 0, 0), (50, 0.0, 7, 0.0, 12, 0.0, 0, 0, 1, 0, 0, 0), (3, 1.0, 3, 1.0, 3, 1.0, 0, 0, 1, 1, 0, 0),
    (8, 0.0, 90, 0.0, 0, 0.0, 0, 0, 1, 0, 0, 0), (5, 0.0, 2, 1.0, 9, 0.0, 0, 0, 1, 0, 1, 0), (22, 0.6, 77, 0.0, 4, 1.0, 0, 0, 1, 0, 0, 0),
    (35, 0.0, 48, 0.0, 9, 0.0, 0, 0, 1, 0, 0, 0), (70, 0.1, 20, 0.0, 66, 0.0, 0, 0, 1, 0, 0, 0), (14, 0.0, 85, 0.0, 31, 0.0, 0, 0, 1, 0, 0, 0),
    (27, 0.0, 3, 1.0, 54, 0.0, 0, 0, 1, 0, 0, 0), (6, 0.0, 72, 0.0, 40, 0.0, 0, 0, 1, 0, 1, 0), (19, 0.2, 63, 0.0, 12, 0.3, 0, 0, 1, 1, 0, 0),
    (41, 0.0, 37, 0.0, 58, 0.1, 0, 0, 1, 0, 0, 0), (11, 0.0, 95, 0.0, 0, 0.0, 0, 0, 1, 0, 0, 0), (56, 0.0, 0, 0.0, 30, 0.0, 0, 0, 1, 0, 0, 0),
    # parts named like a text, which may hold menus too: a link stays where it stands between texts, a run of links goes
    (80, 0.0, 60, 0.0, 70, 0.0, 0, 1, 0, 0, 0, 1), (45, 0.1, 9, 0.0, 70, 0.0, 0, 1, 0, 0, 0, 1), (3, 0.0, 80, 0.0, 66, 0.0, 0, 1, 0, 0, 0, 1),
    (1, 0.0, 1, 0.0, 90, 0.1, 0, 1, 0, 0, 0, 1), (12, 0.0, 0, 0.0, 0, 0.0, 0, 1, 0, 0, 0, 1), (7, 0.0, 0, 0.0, 60, 0.0, 0, 1, 0, 0, 1, 1),
    (5, 0.0, 60, 0.0, 44, 0.0, 0, 1, 0, 0, 1, 1), (6, 0.0, 20, 0.0, 5, 0.0, 0, 1, 0, 1, 0, 1), (14, 0.3, 7, 0.0, 11, 0.0, 0, 1, 0, 1, 0, 1),
    (25, 0.2, 6, 1.0, 7, 1.0, 0, 1, 0, 0, 0, 1), (33, 0.4, 50, 0.0, 20, 0.1, 0, 1, 0, 0, 0, 1), (9, 0.0, 4, 1.0, 55, 0.0, 0, 1, 0, 0, 1, 1),
    (12, 1.0, 55, 0.0, 61, 0.0, 0, 1, 0, 0, 0, 1), (3, 1.0, 40, 0.0, 33, 0.1, 0, 1, 0, 0, 0, 1), (6, 0.9, 20, 0.0, 8, 0.0, 0, 1, 0, 0, 0, 1),
    (4, 1.0, 9, 0.0, 12, 0.0, 0, 1, 0, 1, 0, 1), (5, 1.0, 70, 0.1, 0, 0.0, 0, 1, 0, 0, 0, 1), (2, 1.0, 15, 0.2, 26, 0.0, 0, 1, 0, 0, 0, 1),
    (6, 0.0, 1, 1.0, 38, 0.0, 0, 1, 0, 0, 1, 1), (3, 0.0, 2, 1.0, 20, 0.0, 0, 1, 0, 0, 0, 1), (7, 0.0, 4, 1.0, 9, 0.0, 0, 1, 0, 0, 0, 1),
    (40, 0.0, 3, 1.0, 2, 1.0, 0, 1, 0, 0, 0, 1), (18, 0.0, 2, 0.0, 5, 1.0, 0, 1, 0, 0, 0, 1), (9, 0.0, 4, 0.0, 3, 1.0, 0, 1, 0, 0, 0, 1),
    (7, 1.0, 80, 0.0, 64, 0.0, 0, 1, 0, 0, 0, 1), (4, 1.0, 92, 0.1, 12, 0.0, 0, 1, 0, 0, 0, 1), (10, 0.8, 66, 0.0, 75, 0.2, 0, 1, 0, 1, 0, 1),
    (8, 1.0, 71, 0.0, 39, 0.0, 0, 1, 0, 0, 0, 1), (5, 0.9, 63, 0.0, 80, 0.0, 0, 1, 0, 0, 0, 1), (3, 1.0, 85, 0.0, 7, 0.1, 0, 1, 0, 1, 0, 1),
    (1, 1.0, 1, 1.0, 1, 1.0, 0, 1, 0, 1, 0, 0), (2, 1.0, 0, 0.0, 2, 1.0, 0, 1, 0, 1, 0, 0), (3, 1.0, 60, 0.0, 4, 1.0, 0, 1, 0, 1, 0, 0),
    (4, 1.0, 3, 1.0, 52, 0.0, 0, 1, 0, 1, 0, 0), (2, 1.0, 5, 1.0, 0, 0.0, 0, 1, 0, 0, 0, 0), (8, 0.9, 9, 1.0, 7, 0.9, 0, 1, 0, 0, 0, 0),
    (5, 1.0, 4, 1.0, 6, 0.0, 0, 1, 0, 0, 1, 0), (6, 1.0, 30, 0.0, 5, 1.0, 0, 1, 0, 0, 0, 0), (3, 1.0, 2, 1.0, 44, 0.0, 0, 1, 0, 0, 0, 0),
    (1, 1.0, 70, 0.0, 1, 1.0, 0, 1, 0, 1, 0, 0), (9, 1.0, 25, 0.1, 8, 1.0, 0, 1, 0, 0, 0, 0), (2, 1.0, 2, 1.0, 18, 0.2, 0, 1, 0, 1, 0, 0),
    (2, 1.0, 4, 1.0, 60, 0.0, 0, 1, 0, 1, 0, 0), (5, 1.0, 3, 1.0, 77, 0.1, 0, 1, 0, 1, 0, 0), (3, 1.0, 81, 0.0, 2, 1.0, 0, 1, 0, 1, 0, 0),
    # pages that mark no article: long blocks of few links and what is near them
    (60, 0.0, 55, 0.0, 48, 0.1, 0, 0, 0, 0, 0, 1), (25, 0.1, 70, 0.0, 3, 1.0, 0, 0, 0, 0, 0, 1), (40, 0.0, 4, 1.0, 80, 0.0, 0, 0, 0, 0, 0, 1),
    (7, 0.0, 66, 0.0, 59, 0.0, 0, 0, 0, 0, 0, 1), (2, 0.0, 31, 0.0, 72, 0.0, 0, 0, 0, 0, 0, 1), (6, 0.0, 2, 1.0, 85, 0.0, 0, 0, 0, 0, 1, 1),
    (4, 0.0, 47, 0.0, 39, 0.0, 0, 0, 0, 0, 1, 1), (11, 0.0, 52, 0.0, 13, 0.0, 0, 0, 0, 1, 0, 1), (18, 0.0, 0, 0.0, 0, 0.0, 0, 0, 0, 0, 0, 1),
    (1, 1.0, 1, 1.0, 2, 1.0, 0, 0, 0, 1, 0, 0), (3, 1.0, 60, 0.0, 2, 1.0, 0, 0, 0, 0, 0, 0), (9, 0.9, 4, 1.0, 7, 1.0, 0, 0, 0, 0, 0, 0),
    (30, 0.8, 5, 1.0, 9, 0.9, 0, 0, 0, 0, 0, 0), (5, 0.0, 2, 1.0, 3, 1.0, 0, 0, 0, 0, 0, 0), (6, 0.2, 3, 1.0, 0, 0.0, 0, 0, 0, 0, 0, 0),
    (65, 0.0, 58, 0.0, 5, 0.0, 0, 0, 0, 0, 0, 1), (90, 0.05, 4, 1.0, 2, 1.0, 0, 0, 0, 0, 0, 1), (35, 0.0, 2, 1.0, 6, 0.0, 0, 0, 0, 0, 0, 1),
    (120, 0.1, 9, 0.0, 8, 0.0, 0, 0, 0, 0, 0, 1), (48, 0.2, 33, 0.0, 1, 1.0, 0, 0, 0, 0, 0, 1), (26, 0.0, 12, 0.0, 3, 0.5, 0, 0, 0, 0, 0, 1),
    (3, 0.0, 44, 0.0, 52, 0.0, 0, 0, 0, 0, 0, 1), (10, 0.1, 38, 0.0, 41, 0.0, 0, 0, 0, 0, 0, 1), (8, 0.0, 29, 0.0, 64, 0.1, 0, 0, 0, 0, 0, 1),
    (3, 0.0, 1, 1.0, 2, 1.0, 0, 0, 0, 0, 0, 0), (7, 0.0, 2, 1.0, 1, 1.0, 0, 0, 0, 0, 0, 0), (4, 0.0, 5, 0.0, 1, 1.0, 0, 0, 0, 1, 0, 0),
    (60, 0.9, 2, 1.0, 55, 0.0, 0, 0, 0, 0, 0, 0), (28, 0.7, 61, 0.0, 34, 0.0, 0, 0, 0, 0, 0, 0), (5, 1.0, 70, 0.0, 48, 0.0, 0, 0, 0, 1, 0, 0),
    (40, 0.0, 75, 0.0, 52, 0.0, 0, 0, 0, 0, 0, 1), (22, 0.1, 90, 0.0, 18, 0.0, 0, 0, 0, 0, 0, 1), (3, 0.0, 110, 0.0, 64, 0.0, 0, 0, 0, 0, 0, 1),
    (12, 0.0, 68, 0.0, 9, 0.0, 0, 0, 0, 0, 0, 1), (4, 0.0, 83, 0.0, 0, 0.0, 0, 0, 0, 0, 0, 1), (9, 0.0, 72, 0.1, 44, 0.0, 0, 0, 0, 1, 0, 1),
    (3, 1.0, 12, 0.0, 20, 0.0, 0, 0, 0, 0, 0, 0), (6, 0.9, 30, 0.0, 8, 0.0, 0, 0, 0, 0, 0, 0), (2, 1.0, 9, 0.0, 14, 0.1, 0, 0, 0, 1, 0, 0),
    (8, 1.0, 44, 0.0, 33, 0.0, 0, 0, 0, 0, 0, 0), (4, 0.8, 18, 0.0, 52, 0.0, 0, 0, 0, 0, 0, 0), (11, 1.0, 88, 0.0, 70, 0.0, 0, 0, 0, 0, 0, 0),
    (4, 0.0, 1, 1.0, 70, 0.0, 0, 0, 0, 0, 1, 1), (8, 0.0, 3, 1.0, 95, 0.0, 0, 0, 0, 0, 1, 1), (5, 0.0, 4, 1.0, 60, 0.1, 0, 0, 0, 0, 1, 1),
    (5, 1.0, 2, 1.0, 66, 0.0, 0, 0, 0, 1, 0, 0), (3, 1.0, 1, 1.0, 91, 0.0, 0, 0, 0, 0, 0, 0), (8, 1.0, 6, 1.0, 58, 0.1, 0, 0, 0, 0, 0, 0),
    (70, 0.0, 3, 1.0, 4, 1.0, 0, 0, 0, 0, 0, 1), (55, 0.1, 2, 1.0, 1, 1.0, 0, 0, 0, 0, 0, 1), (110, 0.0, 5, 1.0, 2, 1.0, 0, 0, 0, 0, 0, 1), (30, 0.0, 4, 1.0, 3, 0.9, 0, 0, 0, 0, 0, 1),
    (3, 0.0, 1, 1.0, 40, 0.0, 0, 0, 0, 0, 1, 1), (6, 0.0, 2, 1.0, 35, 0.0, 0, 0, 0, 0, 1, 1), (2, 0.0, 1, 1.0, 28, 0.0, 0, 0, 0, 0, 1, 1),
    # there the neighbours tell the last line of a text from the heading of a list of links
    (6, 0.0, 5, 1.0, 40, 0.9, 0, 0, 0, 0, 0, 0), (5, 0.0, 3, 1.0, 28, 0.8, 0, 0, 0, 0, 1, 0), (7, 0.1, 2, 1.0, 33, 1.0, 0, 0, 0, 0, 0, 0),
    (4, 0.0, 6, 0.9, 50, 0.9, 0, 0, 0, 0, 1, 0), (6, 0.0, 60, 0.0, 40, 0.9, 0, 0, 0, 0, 0, 1), (8, 0.0, 45, 0.0, 25, 1.0, 0, 0, 0, 0, 0, 1),
    (5, 0.0, 70, 0.1, 30, 0.8, 0, 0, 0, 0, 0, 1), (4, 0.0, 52, 0.0, 45, 1.0, 0, 0, 0, 0, 0, 1), (7, 0.0, 36, 0.0, 2, 1.0, 0, 0, 0, 0, 0, 1),
    (12, 1.0, 50, 0.0, 3, 1.0, 0, 0, 0, 1, 0, 0), (4, 1.0, 3, 1.0, 45, 0.0, 0, 0, 0, 0, 1, 0), (2, 0.0, 1, 1.0, 1, 1.0, 0, 0, 0, 1, 0, 0),
)


def grow(x: np.ndarray, y: np.ndarray, depth: int = 8) -> tuple:
    """A decision tree by Gini impurity: (feature, limit, low side, high side) or (label,)."""
    if depth == 0 or len(set(y.tolist())) < 2:
        return (int(2 * y.sum() > len(y)),)
    best = None
    for f in ORDER:
        values = np.unique(x[:, f])
        for limit in (values[1:] + values[:-1]) / 2:
            low = x[:, f] <= limit
            if min(low.sum(), (~low).sum()) < 3:
                continue
            cost = sum(len(s) * s.mean() * (1 - s.mean()) for s in (y[low], y[~low]))
            if best is None or cost < best[0] - 1e-12:
                best = (cost, f, float(limit), low)
    if best is None:
        return (int(2 * y.sum() > len(y)),)
    _, f, limit, low = best
    return (f, limit, grow(x[low], y[low], depth - 1), grow(x[~low], y[~low], depth - 1))


def train(rows=LABELLED) -> tuple:
    """The tree that `rows` teach."""
    data = np.array(rows, float)
    return grow(data[:, :-1], data[:, -1])


def decide(tree: tuple, x: tuple) -> int:
    while len(tree) > 1:
        tree = tree[2] if x[tree[0]] <= tree[1] else tree[3]
    return tree[0]


def used(tree: tuple) -> set[str]:
    """The features that a tree asks for."""
    return {FEATURES[tree[0]]} | used(tree[2]) | used(tree[3]) if len(tree) > 1 else set()


@dataclass
class Block:
    text: str
    words: int
    links: float
    around: int
    named: tuple[int, ...]
    inside: int
    item: int
    heading: int
    form: int

    @property
    def weight(self) -> int:
        """Its words, if they are text and no links."""
        return self.words if self.links <= 0.5 else 0


@dataclass
class _Open:
    tag: str = ""
    around: int = 0
    named: tuple[int, ...] = ()
    inside: int = 0
    article: int = 0
    head: int = 0
    hidden: int = 0
    item: int = 0
    heading: int = 0
    link: int = 0
    form: int = 0


@dataclass
class _Piece:
    parts: list[str] = field(default_factory=list)
    linked: list[bool] = field(default_factory=list)


class Flat(HTMLParser):
    """The text blocks of a page in order; unclosed and stray tags are borne.

    Parts that are around the text by their element are told apart from parts that only have such a name, each
    with a number: `titled` has the numbers of those in which an article, a main part or a first heading begins.
    """

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.blocks: list[Block] = []
        self.stack = [_Open()]
        self.piece = _Piece()
        self.names = 0
        self.titled: set[int] = set()

    def cut(self) -> None:
        """End the block at hand."""
        if not self.piece.parts:
            return
        text = SPACES.sub(" ", "".join(self.piece.parts)).strip()
        if text:
            counts = [(len(p.split()), own) for p, own in zip(self.piece.parts, self.piece.linked, strict=True)]
            n, top = max(1, sum(c for c, _ in counts)), self.stack[-1]
            around = int(top.around or (top.head and not top.heading))
            self.blocks.append(Block(text, len(text.split(" ")), sum(c for c, own in counts if own) / n, around, top.named, top.inside, top.item, top.heading, top.form))
        self.piece = _Piece()

    def leave(self, tag: str, within: frozenset = frozenset()) -> None:
        """Close the open element `tag`, whose end tag may be left out, but not from inside one of `within`."""
        for i in range(len(self.stack) - 1, 0, -1):
            if self.stack[i].tag in within:
                return
            if self.stack[i].tag == tag:
                self.cut()
                del self.stack[i:]
                return

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag not in HEAD_TAGS:
            self.leave("head", HIDDEN_TAGS - {"head"})
        if tag in BLOCK_TAGS:
            self.leave("button", BLOCK_TAGS)  # it holds no blocks
            self.cut()
        if tag == "br":
            self.handle_data(" ")
        if tag in VOID_TAGS:
            return
        while tag in ("p", "li", "dt", "dd", "tr", "td", "th", "option") and self.closes(tag):
            pass
        top = self.stack[-1]
        names = " ".join(x for k, v in attrs if k in ("class", "id", "role") and v for x in v.split() if not ASIDE_NAMES.fullmatch(x))
        style = next((v or "" for k, v in attrs if k == "style"), "").replace(" ", "").lower()
        hidden = tag in HIDDEN_TAGS or "display:none" in style or any(k == "hidden" or (k == "aria-hidden" and v == "true") for k, v in attrs)
        inside = 2 if tag == "article" else int(tag == "main" or (tag in ("div", "section", "td") and bool(INSIDE_NAMES.search(names))))
        around, named = tag in AROUND_TAGS, top.named
        head = top.head
        if tag == "article":
            if READERS.search(names) or top.around:
                around, inside = True, 0
        elif tag not in ("html", "body", "main") and tag not in QUOTE_TAGS and AROUND_NAMES.search(names):
            if top.article and re.search("(?i)header", names):
                head = 1
            else:
                self.names += 1
                named = (*named, self.names)
        if tag in ("header", "hgroup") and top.article:
            around, head = False, 1  # an article's own: its headings are text
        if tag in ("article", "main", "h1") and not around:
            self.titled.update(top.named)
        # a form around an article is the page's, not a part of it
        form = 0 if inside else int(tag == "form" or top.form)
        self.stack.append(
            _Open(
                tag, int(top.around or around), named, max(top.inside, inside), int(top.article or (tag == "article" and not around)), head, int(top.hidden or hidden),
                int(tag == "li" or (top.item and tag not in BLOCK_TAGS)), int(re.fullmatch("h[1-6]", tag) is not None or (top.heading and tag not in BLOCK_TAGS)),
                int(tag == "a" or (top.link and tag not in BLOCK_TAGS)), form,
            )
        )

    def closes(self, tag: str) -> bool:
        """Whether an element that the start of `tag` ends is open; it is closed."""
        ends = {"p": ("p",), "li": ("li", "p"), "dt": ("dt", "dd", "p"), "dd": ("dt", "dd", "p"), "tr": ("tr", "td", "th", "p"), "td": ("td", "th", "p"), "th": ("td", "th", "p"), "option": ("option",)}[tag]
        for i in range(len(self.stack) - 1, 0, -1):
            own = self.stack[i].tag
            if own in ends:
                del self.stack[i:]
                return True
            if own in BLOCK_TAGS:
                return False
        return False

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)  # a slash closes nothing in HTML, but for void elements

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCK_TAGS:
            self.cut()
        for i in range(len(self.stack) - 1, 0, -1):
            if self.stack[i].tag == tag:
                del self.stack[i:]
                return
            if tag not in BLOCK_TAGS and self.stack[i].tag in BLOCK_TAGS:
                return  # an inline end tag does not reach out of its block

    def handle_data(self, data: str) -> None:
        if self.stack[-1].tag == "head" and not data.isspace():
            self.leave("head")
        top = self.stack[-1]
        if not top.hidden:
            self.piece.parts.append(data)
            self.piece.linked.append(bool(top.link))


def parsed(html: str | None) -> Flat:
    """A page's text blocks; none for null, empty or blank pages."""
    parser = Flat()
    if html:
        parser.feed(html)
        parser.close()
        parser.cut()
    return parser


def main_text(html: str | None, tree: tuple) -> str:
    """The main text of a page.

    A part with a name of parts around the text is the page's wrapper, whatever its name, if it holds an article,
    a main part or a first heading and half of the words. Forms are parts around it, too. Where nothing would be
    left, every part that holds half of the words counts as a wrapper, and then forms as well.
    """
    page = parsed(html)
    held: dict[int, int] = {}
    for b in page.blocks:
        for k in b.named:
            held[k] = held.get(k, 0) + (0 if b.around else b.weight)
    half = sum(b.weight for b in page.blocks if not b.around) / 2
    wide = {k for k, n in held.items() if n >= half}
    for wrappers, forms in ((wide & page.titled, True), (wide, True), (wide, False)):
        text = chosen(page.blocks, tree, wrappers, forms)
        if text:
            return text
    return ""


def chosen(blocks: list[Block], tree: tuple, wrappers: set[int], forms: bool) -> str:
    around = [int(b.around or (forms and b.form) or any(k not in wrappers for k in b.named)) for b in blocks]
    weight = [0, 0, 0]  # words outside, in parts named like a text, and in articles
    for b, own in zip(blocks, around, strict=True):
        weight[b.inside] += 0 if own else b.weight
    found = {b.inside for b, own in zip(blocks, around, strict=True) if not own}
    # what the page marks: articles, unless most of the text is in parts named like one; such a part, if it holds a third
    mark = 2 if 2 in found and weight[2] >= weight[1] else 1 if 1 in found and 3 * (weight[1] + weight[2]) >= sum(weight) else 0
    out = []
    for i, (b, own) in enumerate(zip(blocks, around, strict=True)):
        before, after = blocks[i - 1] if i else None, blocks[i + 1] if i + 1 < len(blocks) else None
        x = (b.words, b.links, before.words if before else 0, before.links if before else 0.0, after.words if after else 0, after.links if after else 0.0, own, min(b.inside, mark), int(b.inside < mark and not own), b.item, b.heading)
        if decide(tree, x):
            out.append(b.text)
    return "\n\n".join(out)


def extract(pages: DataFrame, html: str = "html", out: str = "text") -> DataFrame:
    """`pages` without `html`, with `out`: the main text of each whole page, blocks joined by an empty line.

    Null, empty and textless pages give an empty string. A page of any length is read whole, in one task. One row for each row; repeated pages give equal texts.
    A column named like `out` is replaced, all others are kept.
    """
    rest = [c for c in pages.columns if c not in (html, out)]
    rows = pages.select(*rest, html)
    schema = pages.select(*rest).withColumn(out, F.lit("")).schema
    tree = train()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(batch.column(len(rest))[i].as_py(), tree) for i in range(len(batch))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string())], names=[*rest, out])

    return rows.mapInArrow(run, schema)


def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
