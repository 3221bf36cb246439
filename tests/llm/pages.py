"""Pages of other layouts than those the tree of html_text is grown on; marked and filled like them."""

#: The test pages.
PAGES = (
    """<body class="page"><div class="page-wrapper"><div class="masthead"><p>~4~</p></div><div class="content no-sidebar"><h1 data-main>~6~</h1><p data-main>~40~</p><p data-main>~55~</p><p data-main>~38~</p></div><div class="site-footer"><p>~9~</p></div></div></body>""",
    """<body><article class="post no-comments"><h1 data-main>~5~</h1><p data-main>~30~</p><p data-main>~45~</p></article></body>""",
    """<body><header><a href=/>~2~</a></header><article><div class="entry-header"><h1 data-main>~8~</h1></div><div class="entry-content"><p data-main>~66~</p><p data-main>~42~</p></div><div class="post-comments"><p>~20~</p></div></article></body>""",
    """<body><nav>~5~</nav><article><h1 data-main>~4~</h1><p data-main>~35~ <math><mi>~1~</mi></math> ~4~</p><p data-main><svg><text>~3~</text></svg></p><p data-main>~50~</p></article></body>""",
    """<body><main id="main"><h1 data-main>~9~</h1><div data-main>~48~</div><div class="adsbox ads">~7~</div><div data-main>~61~</div><section class="replies"><p>~31~</p></section></main><footer>~6~</footer></body>""",
    """<body><div role="navigation"><a href=1>~1~</a><a href=2>~1~</a></div><div role="main"><h1 data-main>~5~</h1><p data-main>~47~</p><p data-main>~52~</p></div><div role="complementary"><p>~16~</p></div><div role="contentinfo"><p>~8~</p></div></body>""",
    """<body><ul class="menu"><li><a href=1>~2~</a></li><li><a href=2>~1~</a></li></ul><section><h1 data-main>~6~</h1><p data-main>~70~</p><h2 data-main>~4~</h2><p data-main>~33~</p><h2 data-main>~2~</h2><p data-main>~59~</p></section><div class="cookieConsent">~13~</div></body>""",
    """<table><tr><td><a href=1>~1~</a><td><a href=2>~1~</a><td><a href=3>~1~</a></table><div><h1 data-main>~7~</h1><p data-main>~88~<p data-main>~46~<p data-main>~51~</div><hr><div><a href=4>~2~</a> ~2~</div>""",
    """<body><article><header><h1 data-main>~6~</h1><p data-main>~12~</p></header><p data-main>~41~</p><p data-main><a href=z>~4~</a></p><p data-main>~37~</p><footer>~7~</footer></article><article class="comment"><p>~11~</p></article></body>""",
    """<body><nav><a href=1>~1~</a></nav><div class="ad">~11~</div><article><h1 data-main>~1~</h1><p data-main>~1~</p></article><footer>~3~</footer></body>""",
    """<body><nav><a href=1>~1~</a></nav><article><h1 data-main>~3~</h1><p data-main>~400~</p><p data-main>~300~</p><p data-main>~2~</p></article><div class="ad">~8~</div><footer>~3~</footer></body>""",
    """<body><div class="breadcrumb"><a href=1>~1~</a> / <a href=2>~2~</a></div><div><h1 data-main>~5~</h1><p data-main>~34~</p><blockquote data-main>~21~</blockquote><p data-main>~45~</p><pre data-main>~18~</pre><p data-main>~27~</p></div><div class="pagination"><a href=3>~1~</a> <a href=4>~1~</a></div></body>""",
    """<body><div id="header"><h2>~3~</h2></div><div id="wrap"><div id="main"><h1 data-main>~7~</h1><p data-main>~53~</p><p data-main>~60~</p></div><div id="sidebar"><h3>~2~</h3><p>~18~</p></div></div><div id="footer">~8~</div></body>""",
    """<body><form action=s><input name=q><button>~1~</button></form><main><article><h1 data-main>~8~</h1><p data-main>~29~</p><p data-main>~44~</p><aside>~17~</aside><p data-main>~36~</p></article></main><dialog>~12~</dialog></body>""",
    """<body><header><p>~5~</p></header><main><h1 data-main>~4~</h1><ol><li data-main>~14~</li><li data-main>~22~</li><li data-main>~9~</li></ol><p data-main>~48~</p></main><div class="newsletter-signup"><p>~10~</p></div><footer><p>~7~</p></footer></body>""",
    """<body><div>~2~</div><h1 data-main>~5~</h1><p data-main>~62~</p><p data-main>~71~</p><p data-main>~58~</p><div><a href=1>~2~</a> <a href=2>~3~</a></div></body>""",
    """<body><div class="story"><div class="story-header"><h1 data-main>~9~</h1></div><p data-main>~37~</p><p data-main>~49~</p><div class="related-links"><ul><li><a href=1>~6~</a></li><li><a href=2>~5~</a></li></ul></div><p data-main>~40~</p></div><div class="copyright">~6~</div></body>""",
    """<body><nav><ul><li><a href=1>~1~<li><a href=2>~2~</ul></nav><article><h1 data-main>~5~</h1><p data-main><b>~3~.<br><p data-main>~25~</p><p data-main>~1~</p><p data-main>~80~</p><div class="notice notice-info">~9~</div><p data-main>~2~</p></article><div class="comments-area"><ol><li>~22~</li><li>~35~</li></ol></div></body>""",
    """<body><div class="topbar">~6~</div><div class="has-sidebar has-comments"><h1 data-main>~6~</h1><p data-main>~50~</p><p data-main>~43~</p></div><div class="sharing"><a href=1>~1~</a></div></body>""",
    """<body><article class="h-entry"><h1 data-main>~7~</h1><div><div><p data-main>~54~</p></div><div><p data-main>~32~</p></div></div><table><tr><td data-main>~2~</td><td data-main>~3~</td></tr></table></article><aside><p>~40~</p></aside></body>""",
    """<body><center>~3~</center><font><p data-main>~90~</p><p data-main>~75~</p></font><center><a href=1>~2~</a></center></body>""",
    """<body><main><div class="alert">~10~</div><h1 data-main>~6~</h1><p data-main>~39~</p><h2 data-main>~3~</h2><p data-main>~5~</p><h2 data-main>~2~</h2><p data-main>~56~</p><div class="recommended"><p>~15~</p><p>~12~</p></div></main></body>""",
    """<body><div class="menu-left"><p><a href=1>~2~</a></p><p><a href=2>~2~</a></p></div><div class="text"><p data-main>~65~</p><p data-main>~4~</p><p data-main>~58~ <a href=3>~2~</a></p></div><div class="comment-form"><p>~8~</p></div><div class="comment-list"><p>~24~</p><p>~19~</p></div></body>""",
    """<body><section class="hero banner"><h1>~4~</h1></section><article><h2 data-main>~5~</h2><p data-main>~46~</p><figure><figcaption data-main>~9~</figcaption></figure><p data-main hidden>~12~</p><p data-main>~53~</p></article><section class="sponsored"><p>~20~</p></section></body>""",
    # short lines
    """<body><header><a href=/>~2~</a></header><section><h2 data-main>~3~</h2><div data-main>~5~</div><div data-main>~4~</div><div data-main>~6~</div><div data-main>~5~</div><div data-main>~4~</div><div data-main>~7~</div><div data-main>~5~</div></section><footer><p>~3~</p></footer></body>""",
    """<body><nav><ul><li><a href=1>~1~</a></li><li><a href=2>~1~</a></li></ul></nav><div id="recipe"><h1 data-main>~2~</h1><h2 data-main>~1~</h2><ul><li data-main>~3~</li><li data-main>~2~</li><li data-main>~3~</li></ul><h2 data-main>~1~</h2><ol><li data-main>~11~</li><li data-main>~16~</li></ol></div></body>""",
    """<body><div><p data-main>~44~</p><p data-main>~2~</p><p data-main>~1~</p><p data-main>~57~</p><p data-main>~1~</p><p data-main>~33~</p></div></body>""",
    """<body><h1 data-main><a href=x>~7~</a></h1><p data-main>~61~</p><p data-main>~29~</p><p><a href=1>~2~</a> <a href=2>~1~</a> <a href=3>~2~</a></p></body>""",
)
