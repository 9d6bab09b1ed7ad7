"""Declared schemas of rule sets, feeds, replace rules and the shelf file."""

from __future__ import annotations

# Field names of the rule groups of a source file.
LIST_FIELDS = [
    "bookList", "name", "author", "intro", "kind", "lastChapter", "updateTime", "bookUrl", "coverUrl", "wordCount",
]
RULE_GROUPS = {
    "ruleSearch": ["checkKeyWord", *LIST_FIELDS],
    "ruleExplore": LIST_FIELDS,
    "ruleBookInfo": [
        "init", "name", "author", "intro", "kind", "lastChapter", "updateTime", "coverUrl", "tocUrl", "wordCount",
        "canReName", "downloadUrls",
    ],
    "ruleToc": [
        "preUpdateJs", "chapterList", "chapterName", "chapterUrl", "formatJs", "isVolume", "isVip", "isPay",
        "updateTime", "nextTocUrl",
    ],
    "ruleContent": [
        "content", "title", "nextContentUrl", "webJs", "sourceRegex", "replaceRegex", "imageStyle", "imageDecode",
        "payAction",
    ],
    "ruleReview": [
        "reviewUrl", "avatarRule", "contentRule", "postTimeRule", "reviewQuoteUrl", "voteUpUrl", "voteDownUrl",
        "postReviewUrl", "postQuoteUrl", "deleteUrl",
    ],
}
SOURCE_FIELDS = [
    ("bookSourceUrl", "STRING"), ("bookSourceName", "STRING"), ("bookSourceGroup", "STRING"),
    ("bookSourceType", "INT"), ("bookUrlPattern", "STRING"), ("customOrder", "INT"), ("enabled", "BOOLEAN"),
    ("enabledExplore", "BOOLEAN"), ("enabledCookieJar", "BOOLEAN"), ("concurrentRate", "STRING"),
    ("header", "STRING"), ("jsLib", "STRING"), ("loginUrl", "STRING"), ("loginUi", "STRING"),
    ("loginCheckJs", "STRING"), ("coverDecodeJs", "STRING"), ("bookSourceComment", "STRING"),
    ("variableComment", "STRING"), ("lastUpdateTime", "BIGINT"), ("respondTime", "BIGINT"), ("weight", "INT"),
    ("exploreUrl", "STRING"), ("exploreScreen", "STRING"), ("searchUrl", "STRING"),
]
FEED_FIELDS = [
    ("sourceUrl", "STRING"), ("sourceName", "STRING"), ("sourceIcon", "STRING"), ("sourceGroup", "STRING"),
    ("sourceComment", "STRING"), ("enabled", "BOOLEAN"), ("singleUrl", "BOOLEAN"), ("sortUrl", "STRING"),
    ("customOrder", "INT"), ("concurrentRate", "STRING"), ("header", "STRING"), ("variableComment", "STRING"),
    ("ruleArticles", "STRING"), ("ruleNextPage", "STRING"), ("ruleTitle", "STRING"), ("rulePubDate", "STRING"),
    ("ruleDescription", "STRING"), ("ruleImage", "STRING"), ("ruleLink", "STRING"), ("ruleContent", "STRING"),
]
REPLACE_RULE_FIELDS = [
    ("id", "BIGINT"), ("name", "STRING"), ("group", "STRING"), ("pattern", "STRING"), ("replacement", "STRING"),
    ("scope", "STRING"), ("scopeTitle", "BOOLEAN"), ("scopeContent", "BOOLEAN"), ("excludeScope", "STRING"),
    ("isEnabled", "BOOLEAN"), ("isRegex", "BOOLEAN"), ("timeoutMillisecond", "BIGINT"), ("sortOrder", "INT"),
    ("order", "INT"),
]


def ddl(fields: list[tuple[str, str]]) -> str:
    return ", ".join(f"`{name}` {kind}" for name, kind in fields)


def group_ddl(group: str) -> str:
    return ddl([(name, "STRING") for name in RULE_GROUPS[group]])


# A rule group may be an object or a string that holds one, so it is read as text first.
SOURCE_TEXT = ddl([*SOURCE_FIELDS, *[(g, "STRING") for g in RULE_GROUPS]])

PAGE = "url STRING, body STRING, status_code INT, headers MAP<STRING,STRING>"

PROGRESS = (
    "STRUCT<chapter_index: INT, chapter_title: STRING, chapter_url: STRING, scroll_y: DOUBLE, max_scroll_y: DOUBLE, "
    "scroll_ratio: DOUBLE, chapter_total: INT, updated_at: BIGINT>"
)
BOOK = (
    "STRUCT<bookUrl: STRING, name: STRING, author: STRING, kind: STRING, latestChapterTitle: STRING, "
    "canUpdate: BOOLEAN, totalChapterNum: INT>"
)
SHELF_ENTRY = (
    f"STRUCT<key: STRING, added_at: BIGINT, updated_at: BIGINT, book: {BOOK}, "
    f"source: STRUCT<bookSourceUrl: STRING, bookSourceName: STRING>, progress: {PROGRESS}>"
)
BOOKMARK = (
    "STRUCT<time: BIGINT, bookName: STRING, bookAuthor: STRING, chapterIndex: INT, chapterName: STRING, "
    "content: STRING>"
)
STATE_FILE = (
    f"bookshelf ARRAY<{SHELF_ENTRY}>, bookmarks ARRAY<{BOOKMARK}>, search_history ARRAY<STRING>, "
    "source_health MAP<STRING, STRUCT<passed: BOOLEAN, message: STRING, tested_at: BIGINT>>"
)
