"""Plain-Python model of the lexical tag rules, used only as a test oracle.

A tag starts at a '<' followed by a/link (attribute href) or img/script
(attribute src).  Its text is read as a sequence of units -- a quoted value
of the link attribute or of ``type``, or any single character -- until the
first bare '>'.  The last non-empty link value
and type value win; a tag without a link value yields nothing and the search
goes on at the next character.
"""

import re

ATTR = {"a": "href", "link": "href", "img": "src", "script": "src"}
NAME = re.compile(r"a|link|img|script")


def _units(attr):
    return re.compile(rf'({attr}|type)="([^"]*)"|([^"])|"', re.S)


def scan_tags(html: str):
    found = []
    start = 0
    while (lt := html.find("<", start)) >= 0:
        m = NAME.match(html, lt + 1)
        if not m:
            start = lt + 1
            continue
        tag = m.group(0)
        values = {"link": None, "type": None}
        end = None
        for u in _units(ATTR[tag]).finditer(html, lt + 1):
            if u.group(3) == ">":
                end = u.start()
                break
            if u.group(1) and u.group(2):
                values["type" if u.group(1) == "type" else "link"] = u.group(2)
        if end is None or values["link"] is None:
            start = lt + 1
            continue
        found.append((tag, values["link"], values["type"]))
        start = end + 1
    return found
