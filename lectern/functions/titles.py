"""Column functions that read a book's title and author from the head of its text, or from its file's name."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lectern.functions.text import bound, strip

# Labels, marks around titles, what is no title, and what downloads add to names.
LABELLED_TITLE = r"书\s*名\s*[:：]\s*([^\r\n]{1,40})"
LABELLED_AUTHOR = r"作\s*者\s*[:：]\s*([^\r\n]{1,30})"
MARKED_TITLE, MARKED_LINE = r"[《『]([^《》『』\r\n]{1,40})[》』]", 30
REMARKS = r"[\[【(（][^\]】)）]{0,24}[\]】)）]"
NO_TITLE = "[：:。！？；…]"
AUTHOR_AT_END = r"作\s*者\s*[:：]?\s*[^\r\n]{0,12}$"
AUTHOR_ENDS = r"[ \t　|,，;；/\-—（(【\[\]】)}）』」”’'\">》〉]"
MARKS = "《》『』“”‘’"
SUFFIXES = ["TXT下载", "txt下载", "全本完结", "全本", "完结", "全集", "精校版", "校对版", "无删减", "未删节", "无弹窗", "免费阅读", "全集下载", "在线阅读", "下载"]
UNKNOWN_AUTHORS, UNTITLED = ["未知", "不详"], "未命名"


def _unmarked(name: Column) -> Column:
    """Without marks around the whole name, however many."""
    pairs = "|".join(f"{a}.*{b}" for a, b in zip(MARKS[::2], MARKS[1::2], strict=True))
    turns = F.sequence(F.lit(0), F.floor(F.length(name) / 2).cast("int"))
    return F.aggregate(turns, name, lambda s, _: F.when(s.rlike(rf"(?s)^(?:{pairs})$"), strip(F.substr(s, F.lit(2), F.length(s) - 2))).otherwise(s))


def cleaned_title(raw: Column) -> Column:
    """A title without marks around it, remarks in brackets, what downloads add, an author at its end, and separators left over."""
    shorter = lambda name, suffix: F.when(F.endswith(name, suffix) & (F.length(name) > F.length(suffix)), strip(F.substr(name, F.lit(1), F.length(name) - F.length(suffix)))).otherwise(name)
    bare = bound(strip(raw), lambda name: strip(F.regexp_replace(_unmarked(name), REMARKS, "")))
    ended = F.aggregate(F.array(*map(F.lit, SUFFIXES)), bare, shorter)
    before = lambda name: F.regexp_extract(name, rf"(?s)^(.*?){AUTHOR_AT_END}", 1)
    cut = bound(ended, lambda name: F.when(before(name) != "", strip(before(name))).otherwise(name))
    return bound(strip(F.regexp_replace(cut, r"[\-—－_·/]+$", "")), _unmarked)


def title(head: Column, file_name: Column) -> Column:
    """The title by its label, else by the first short line with marks, else by the file's name."""
    head = F.coalesce(head, F.lit(""))
    labelled = F.nullif(cleaned_title(F.regexp_extract(head, LABELLED_TITLE, 1)), F.lit(""))
    lines = F.filter(F.transform(F.split(head, r"\R"), strip), lambda x: (x != "") & (F.length(x) <= MARKED_LINE) & x.rlike(MARKED_TITLE))
    marked = F.filter(F.transform(lines, lambda x: cleaned_title(F.regexp_extract(x, MARKED_TITLE, 0))), lambda x: (x != "") & ~x.rlike(NO_TITLE))
    of_file = cleaned_title(F.regexp_replace(file_name, r"(?s)(?<=.)\.[^.]*$", ""))
    return F.coalesce(labelled, F.get(marked, F.lit(0)), F.nullif(of_file, F.lit("")), F.lit(UNTITLED))


def author(head: Column) -> Column:
    """The author by the label, up to a separator; null if there is none or it is said to be unknown."""
    found = strip(F.regexp_extract(F.coalesce(head, F.lit("")), LABELLED_AUTHOR, 1))
    cut = strip(F.regexp_extract(found, rf"(?s)^(.+?){AUTHOR_ENDS}", 1))
    own = F.when(found.rlike(rf"^{AUTHOR_ENDS}") | (cut == ""), found).otherwise(cut)
    return F.when((own != "") & ~own.isin(*UNKNOWN_AUTHORS), own)
