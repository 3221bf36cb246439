"""Labelled pages that the decision tree of html_text is grown on.

Whole pages of different layouts, written by hand; ~n~ stands for n invented words. The attribute data-main marks
elements whose text is main text; nothing else of a page is.
"""

from __future__ import annotations

import random
import re

SYLLABLES = "ba ce di fo gu la me ni po ru sa te vi wo xu an el in or ut".split()


def fill(page: str, seed: int) -> str:
    """The page with invented words, sentences of seven to fifteen, for each ~n~."""
    rng = random.Random(seed)

    def words(m: re.Match) -> str:
        out, left = [], 0
        for _ in range(int(m[1])):
            w = "".join(rng.choice(SYLLABLES) for _ in range(rng.randint(1, 4)))
            if not left:
                left, w = rng.randint(7, 15), w.capitalize()
            left -= 1
            out.append(w + ("." if not left else ""))
        return " ".join(out)

    return re.sub(r"~(\d+)~", words, page)


#: The labelled pages.
PAGES = (
    # a weblog: article, comments as sections of it, sidebar
    """<html><head><title>~5~</title></head><body class="single post-template"><div id="page" class="site has-sidebar"><header class="site-header"><p>~3~</p><p>~8~</p></header>
    <nav class="main-navigation"><ul><li><a href=a>~1~</a></li><li><a href=b>~2~</a></li><li><a href=c>~1~</a></li></ul></nav><article class="post no-comments"><header class="entry-header"><h1 data-main>~7~</h1></header>
    <p data-main>~60~</p><p data-main>~35~ <a href=q>~3~</a> ~20~</p><h2 data-main>~3~</h2><ul><li data-main>~8~</li><li data-main>~12~</li><li data-main>~5~</li></ul><blockquote><p data-main>~22~</p></blockquote>
    <p data-main>~2~</p><div class="share-buttons"><a href=x>~1~</a><a href=y>~1~</a></div><div class="ad-slot">~9~</div><p data-main>~48~</p><footer><p>~6~</p></footer></article>
    <section class="comments"><h3>~2~</h3><div class="comment"><p>~25~</p></div><div class="comment"><p>~40~</p><p>~12~</p></div></section><aside class="sidebar"><h4>~2~</h4><ul><li><a href=1>~4~</a></li><li><a href=2>~5~</a></li></ul></aside>
    <footer><p>~7~</p></footer></div></body></html>""",
    # a newspaper: main, cookie notice, related links, newsletter form
    """<body><div class="cookie-notice"><p>~24~</p><button>~1~</button></div><div class="topbar"><a href=/>~2~</a> <a href=/l>~1~</a></div><main><h1 data-main>~9~</h1><p data-main>~18~</p><figure><img src=a><figcaption data-main>~11~</figcaption></figure>
    <p data-main>~70~</p><p data-main>~64~</p><div class="related"><p><a href=1>~7~</a></p><p><a href=2>~8~</a></p></div><p data-main>~55~</p><table><tr><th data-main>~1~</th><td data-main>~2~</td></tr><tr><th data-main>~1~</th><td data-main>~3~</td></tr></table>
    <div class="newsletter"><h4>~4~</h4><p>~14~</p><form><label>~2~</label></form></div><p data-main>~44~</p></main><div class="footer"><p>~10~</p><ul><li><a href=a>~1~</a></li><li><a href=b>~2~</a></li></ul></div></body>""",
    # no article element, plain divisions
    """<body><div id="top"><a href=1>~1~</a> | <a href=2>~1~</a> | <a href=3>~1~</a></div><div id="text"><h1 data-main>~6~</h1><p data-main>~50~</p><p data-main>~61~</p><p data-main>~4~</p><p data-main>~72~ <a href=r>~2~</a> ~9~</p><p data-main>~33~</p></div>
    <div id="bottom"><a href=1>~2~</a> <a href=2>~2~</a><p>~5~</p></div></body>""",
    # tables as layout, no classes
    """<table><tr><td colspan=2><a href=1>~1~</a> <a href=2>~1~</a> <a href=3>~2~</a></td></tr><tr><td><a href=m>~2~</a><br><a href=n>~1~</a><br><a href=o>~2~</a></td><td><h2 data-main>~5~</h2><p data-main>~45~<p data-main>~80~<p data-main>~38~</td></tr><tr><td><a href=l>~1~</a> ~3~</td></tr></table>""",
    # a wrapper with a word of furniture
    """<body><div class="content sidebar-right"><div class="header"><a href=/>~2~</a></div><h1 data-main>~8~</h1><p data-main>~52~</p><p data-main>~47~</p><h2 data-main>~2~</h2><p data-main>~66~</p><ol><li data-main>~15~</li><li data-main>~9~</li></ol><p data-main>~30~</p>
    <div class="sidebar"><p>~12~</p><ul><li><a href=1>~3~</a></li><li><a href=2>~4~</a></li></ul></div><div class="comment-list"><p>~16~</p><p>~21~</p></div></div></body>""",
    # a short article among much else
    """<body><nav><a href=1>~1~</a><a href=2>~1~</a><a href=3>~1~</a><a href=4>~1~</a></nav><div class="banner">~12~</div><article><h1 data-main>~4~</h1><p data-main>~9~</p></article><div class="promo"><h3>~3~</h3><p>~30~</p></div><section id="discussion"><p>~28~</p><p>~19~</p></section><footer>~4~</footer></body>""",
    # very short text in an article
    """<html><body><nav><ul><li><a href=1>~1~</a></li><li><a href=2>~1~</a></li></ul></nav><div class="ad">~8~</div><article><h1 data-main>~2~</h1><p data-main>~3~</p><p data-main>~1~</p></article><footer>~2~</footer></body></html>""",
    # headings and single words as paragraphs
    """<body><nav><ul><li><a href=1>~1~</a></li><li><a href=2>~2~</a></li></ul></nav><article><h1 data-main>~6~</h1><p data-main><b>~1~</b><p data-main>~40~</p><p data-main>~1~</p><p data-main>~90~</p><p data-main><b>~2~</b></p><p data-main>~36~</p><p data-main><a href=z>~5~</a></p><p data-main>~51~</p></article><div class="ad">~10~</div><aside><p>~31~</p></aside><footer><p>~3~</p></footer></body>""",
    # documentation: navigation in front, a long list of links
    """<body><div><ul><li><a href=1>~2~</a></li><li><a href=2>~3~</a></li><li><a href=3>~2~</a></li><li><a href=4>~2~</a></li><li><a href=5>~1~</a></li></ul></div><div><h1 data-main>~3~</h1><p data-main>~28~</p><pre data-main>~14~</pre><p data-main>~42~ <a href=6>~1~</a> ~7~</p><h2 data-main>~2~</h2><p data-main>~57~</p><dl><dt data-main>~1~</dt><dd data-main>~20~</dd><dt data-main>~2~</dt><dd data-main>~17~</dd></dl></div><div><p><a href=7>~2~</a> <a href=8>~2~</a></p><p>~4~ <a href=9>~3~</a></p></div></body>""",
    # teasers below the article
    """<body><header><p>~2~</p></header><main><article><h1 data-main>~8~</h1><p data-main>~33~</p><p data-main>~62~</p><p data-main>~58~</p></article><div class="recommended"><div><h3><a href=1>~6~</a></h3><p>~18~</p></div><div><h3><a href=2>~7~</a></h3><p>~20~</p></div></div></main><footer><ul><li><a href=1>~1~</a></li></ul><p>~5~</p></footer></body>""",
    # hot comments: more of them than text, no article element
    """<body><div class="menu"><a href=1>~1~</a> <a href=2>~1~</a></div><div class="body"><h1 data-main>~5~</h1><p data-main>~80~</p><p data-main>~64~</p><p data-main>~71~</p></div><div class="comments"><div><p>~35~</p></div><div><p>~18~</p></div><div><p>~44~</p></div></div><div>~3~ <a href=3>~2~</a></div></body>""",
    # an old page: text between line breaks
    """<body><center><a href=1>~1~</a> - <a href=2>~1~</a> - <a href=3>~1~</a></center><h1 data-main>~4~</h1><div data-main>~120~<br><br>~95~</div><p data-main>~41~</p><center><a href=4>~3~</a></center></body>""",
    # an article with furniture inside
    """<body><article class="story"><nav class="breadcrumbs"><a href=1>~1~</a> <a href=2>~2~</a></nav><h1 data-main>~10~</h1><p data-main>~25~</p><div class="advertisement"><p>~17~</p></div><p data-main>~38~</p><aside><h4>~3~</h4><p>~26~</p></aside><p data-main>~49~</p><form class="login"><p>~9~</p></form><div class="notice"><p>~15~</p></div><p data-main>~5~</p><h3 data-main>~3~</h3><p data-main>~27~</p><div id="disqus_thread"><p>~22~</p></div><footer>~8~</footer></article></body>""",
    # sections without furniture, nested wrappers
    """<body><div><div><div><section><h2 data-main>~4~</h2><p data-main>~31~</p></section><section><h2 data-main>~3~</h2><p data-main>~46~</p><p data-main>~12~</p></section><section><h2 data-main>~5~</h2><p data-main>~53~</p></section></div></div></div><div><a href=1>~1~</a><a href=2>~1~</a><a href=3>~1~</a></div></body>""",
    # names of furniture on wrappers of nearly everything
    """<body><div class="sidebar-layout"><div><a href=1>~1~</a> <a href=2>~1~</a></div><h1 data-main>~6~</h1><p data-main>~57~</p><p data-main>~3~</p><p data-main>~74~</p><p data-main>~29~</p><div>~4~ <a href=3>~2~</a></div></div><div>~5~</div></body>""",
    """<body><div id="widget"><div class="search-page"><h2 data-main>~5~</h2><p data-main>~44~</p><p data-main>~68~</p><ul><li data-main>~11~</li><li data-main>~7~</li></ul></div></div><div class="comments"><p>~30~</p><p>~26~</p><p>~14~</p></div></body>""",
    """<body><div class="promo-page"><article><h1 data-main>~7~</h1><p data-main>~41~</p><p data-main>~2~</p><p data-main>~53~</p></article></div><div class="social"><p>~5~</p></div></body>""",
    # nothing named: lines of furniture without links around the text
    """<body><div>~3~</div><div>~5~</div><div><h1 data-main>~7~</h1><p data-main>~49~</p><p data-main>~62~</p><h2 data-main>~3~</h2><p data-main>~40~</p><p data-main>~6~</p><p data-main>~58~</p></div><div>~4~</div><div>~7~</div></body>""",
    """<body><p>~2~</p><p>~4~</p><p>~1~</p><h1 data-main>~5~</h1><p data-main>~83~</p><p data-main>~47~</p><p data-main>~31~</p><p>~3~</p><p>~6~</p><p>~2~</p></body>""",
    """<body><div>~6~</div><div><p data-main>~39~</p><p data-main>~76~</p><p data-main>~1~</p><p data-main>~45~</p></div><div>~5~</div><div>~3~</div><div><a href=1>~2~</a></div></body>""",
    # link lists in the text and link lists around it
    """<body><ul><li><a href=1>~1~</a></li><li><a href=2>~1~</a></li><li><a href=3>~2~</a></li></ul><div><h1 data-main>~4~</h1><p data-main>~50~</p><ul><li data-main><a href=4>~3~</a> ~9~</li><li data-main><a href=5>~2~</a> ~12~</li></ul><p data-main>~64~</p></div><ul><li><a href=6>~4~</a></li><li><a href=7>~5~</a></li><li><a href=8>~3~</a></li></ul><p>~4~</p></body>""",
    # nothing after the text
    """<body><nav><a href=1>~1~</a> <a href=2>~2~</a></nav><article><h1 data-main>~6~</h1><p data-main>~30~</p><p data-main>~55~</p><p data-main>~12~</p></article></body>""",
    """<article><p data-main>~40~</p><p data-main>~2~</p></article>""",
    """<body><div class="sidebar"><p>~9~</p></div><div class="advert">~14~</div><main><h2 data-main>~4~</h2><p data-main>~70~</p><p data-main>~38~</p></main></body>""",
    """<p data-main>~60~</p><p data-main>~45~</p><p data-main>~8~</p>""",
    """<h1 data-main>~3~</h1><p data-main>~25~</p>""",
    # less text than furniture
    """<body><div class="ads">~10~</div><article><h1 data-main>~2~</h1><p data-main>~2~</p></article><footer>~2~</footer></body>""",
    """<body><div class="banner"><p>~14~</p></div><main><p data-main>~5~</p></main><div class="comments"><p>~30~</p><p>~11~</p></div></body>""",
    """<body><header>~3~</header><div class="notice">~20~</div><article><h1 data-main>~1~</h1></article><aside>~25~</aside></body>""",
    # headings and notices at the edges of the text
    """<body><main><p class="notice">~9~</p><h1 data-main>~5~</h1><p data-main>~50~</p><p data-main>~10~</p><p class="share">~4~</p></main><div>~4~</div></body>""",
    # much outside the article, nothing named
    """<body><div>~35~</div><div>~60~</div><article><h1 data-main>~4~</h1><p data-main>~20~</p><p data-main>~48~</p></article><div>~41~</div><p>~28~</p></body>""",
    """<body><p>~24~</p><main><h1 data-main>~7~</h1><p data-main>~33~</p><p data-main>~2~</p><p data-main>~64~</p></main><section><p>~52~</p><p>~37~</p></section></body>""",
    """<body><div class="ad">~11~</div><article><p data-main>~1~</p></article></body>""",
    """<body><div class="layout sidebar"><article><h1 data-main>~3~</h1><p data-main>~60~</p><p data-main>~44~</p></article><div class="comments"><p>~50~</p><p>~45~</p><p>~33~</p><p>~30~</p></div></div></body>""",
    # links as text of an article
    """<body><nav><a href=1>~2~</a></nav><article><h1 data-main><a href=2>~6~</a></h1><p data-main>~42~</p><h2 data-main>~1~</h2><ul><li data-main><a href=3>~7~</a></li><li data-main><a href=4>~5~</a></li><li data-main><a href=5>~9~</a></li></ul></article><footer><a href=6>~1~</a></footer></body>""",
    """<body><div><a href=1>~3~</a></div><main><h1 data-main>~4~</h1><p data-main><a href=2>~12~</a></p><p data-main>~51~</p><p data-main><a href=3>~3~</a> ~2~</p><p data-main><a href=4>~2~</a></p></main><div><a href=5>~2~</a> <a href=6>~3~</a></div></body>""",
    # short lines as text: poems, recipes, talk, one line, tables, linked titles
    """<body><nav><a href=1>~1~</a> <a href=2>~2~</a></nav><div><h1 data-main>~4~</h1><p data-main>~5~</p><p data-main>~6~</p><p data-main>~4~</p><p data-main>~7~</p><p data-main>~5~</p><p data-main>~6~</p><p data-main>~3~</p><p data-main>~5~</p></div><footer>~4~</footer></body>""",
    """<body><div><a href=1>~1~</a> <a href=2>~1~</a></div><div><div data-main>~6~</div><div data-main>~5~</div><div data-main>~7~</div><div data-main>~4~</div><div data-main>~6~</div><div data-main>~5~</div><div data-main>~6~</div><div data-main>~5~</div></div></body>""",
    """<div><p data-main>~4~</p><p data-main>~6~</p><p data-main>~5~</p><p data-main>~7~</p><p data-main>~3~</p><p data-main>~6~</p></div>""",
    """<body><div class="menu"><a href=1>~1~</a> <a href=2>~1~</a></div><div><h1 data-main>~3~</h1><p data-main>~14~</p><ul><li data-main>~3~</li><li data-main>~2~</li><li data-main>~4~</li><li data-main>~2~</li><li data-main>~3~</li></ul><ol><li data-main>~12~</li><li data-main>~9~</li><li data-main>~15~</li></ol></div><div class="footer">~3~</div></body>""",
    """<body><h1 data-main>~2~</h1><ul><li data-main>~2~</li><li data-main>~3~</li><li data-main>~2~</li><li data-main>~1~</li></ul><p data-main>~25~</p><p data-main>~18~</p></body>""",
    """<body><div><a href=1>~2~</a></div><div><p data-main>~50~</p><p data-main>~1~</p><p data-main>~1~</p><p data-main>~2~</p><p data-main>~38~</p><p data-main>~2~</p><p data-main>~1~</p><p data-main>~3~</p><p data-main>~61~</p></div><div>~3~ <a href=2>~2~</a></div></body>""",
    """<p data-main>~2~</p>""",
    """<div data-main>~5~</div>""",
    """<html><body><p data-main>~7~</p></body></html>""",
    """<body><nav><a href=1>~1~</a> <a href=2>~1~</a></nav><p data-main>~6~</p><footer>~3~</footer></body>""",
    """<body><div><a href=1>~1~</a> <a href=2>~2~</a> <a href=3>~1~</a></div><h1 data-main><a href=4>~6~</a></h1><p data-main>~52~</p><p data-main>~44~</p><div><a href=5>~2~</a> <a href=6>~1~</a></div></body>""",
    """<body><ul><li><a href=1>~1~</a></li><li><a href=2>~1~</a></li></ul><div><h2 data-main><a href=3>~5~</a></h2><p data-main>~40~</p><p data-main>~36~</p></div></body>""",
    """<body><nav><a href=1>~1~</a></nav><div><h1 data-main>~4~</h1><table><tr><th data-main>~1~</th><th data-main>~2~</th><th data-main>~1~</th></tr><tr><td data-main>~1~</td><td data-main>~2~</td><td data-main>~1~</td></tr><tr><td data-main>~2~</td><td data-main>~1~</td><td data-main>~1~</td></tr></table><p data-main>~16~</p></div><footer>~2~</footer></body>""",
    """<body><nav><a href=1>~1~</a></nav><article><h1 data-main>~5~</h1><p data-main>~30~</p><p data-main><a href=2>~2~</a></p><ul><li data-main><a href=3>~3~</a></li><li data-main><a href=4>~2~</a></li><li data-main><a href=5>~3~</a></li></ul><p data-main>~22~</p></article><footer>~2~</footer></body>""",
    # long poems, lists and tables
    """<body><nav><a href=1>~1~</a></nav><div><h1 data-main>~3~</h1><p data-main>~5~</p><p data-main>~6~</p><p data-main>~4~</p><p data-main>~7~</p><p data-main>~2~</p><p data-main>~5~</p><p data-main>~6~</p><p data-main>~4~</p><p data-main>~7~</p><p data-main>~2~</p><p data-main>~5~</p><p data-main>~6~</p><p data-main>~4~</p><p data-main>~7~</p><p data-main>~2~</p><p data-main>~5~</p></div></body>""",
    """<div><p data-main>~6~</p><p data-main>~5~</p><p data-main>~1~</p><p data-main>~7~</p><p data-main>~3~</p><p data-main>~4~</p><p data-main>~6~</p><p data-main>~5~</p><p data-main>~1~</p><p data-main>~7~</p><p data-main>~3~</p><p data-main>~4~</p><p data-main>~6~</p><p data-main>~5~</p><p data-main>~1~</p><p data-main>~7~</p><p data-main>~3~</p><p data-main>~4~</p><p data-main>~6~</p><p data-main>~5~</p><p data-main>~1~</p><p data-main>~7~</p><p data-main>~3~</p><p data-main>~4~</p></div>""",
    """<body><div><a href=1>~1~</a> <a href=2>~2~</a></div><div><div data-main>~4~</div><div data-main>~6~</div><div data-main>~5~</div><div data-main>~2~</div><div data-main>~4~</div><div data-main>~6~</div><div data-main>~5~</div><div data-main>~2~</div><div data-main>~4~</div><div data-main>~6~</div><div data-main>~5~</div><div data-main>~2~</div><div data-main>~4~</div><div data-main>~6~</div><div data-main>~5~</div><div data-main>~2~</div><div data-main>~4~</div><div data-main>~6~</div><div data-main>~5~</div><div data-main>~2~</div></div><div>~3~ <a href=3>~2~</a></div></body>""",
    """<body><div><h2 data-main>~3~</h2><ul><li data-main>~2~</li><li data-main>~3~</li><li data-main>~1~</li><li data-main>~4~</li><li data-main>~2~</li><li data-main>~3~</li><li data-main>~1~</li><li data-main>~4~</li><li data-main>~2~</li><li data-main>~3~</li><li data-main>~1~</li><li data-main>~4~</li><li data-main>~2~</li><li data-main>~3~</li></ul><p data-main>~21~</p></div></body>""",
    """<body><h1 data-main>~4~</h1><table><tr><td data-main>~1~</td><td data-main>~2~</td><td data-main>~1~</td></tr><tr><td data-main>~1~</td><td data-main>~2~</td><td data-main>~1~</td></tr><tr><td data-main>~1~</td><td data-main>~2~</td><td data-main>~1~</td></tr><tr><td data-main>~1~</td><td data-main>~2~</td><td data-main>~1~</td></tr><tr><td data-main>~1~</td><td data-main>~2~</td><td data-main>~1~</td></tr><tr><td data-main>~1~</td><td data-main>~2~</td><td data-main>~1~</td></tr><tr><td data-main>~1~</td><td data-main>~2~</td><td data-main>~1~</td></tr><tr><td data-main>~1~</td><td data-main>~2~</td><td data-main>~1~</td></tr></table></body>""",
)
