"""Labelled pages on which the extraction model is trained: hand-written, one for each
common layout. ``data-main="1"`` marks an element as main text and ``data-main="0"`` a part
of it that is not; the nearest mark above a piece of text is its label, 0 without one. The
marks are removed before features are taken.
"""

_A = "Words of a sentence that goes on for a while, with commas, and then it comes to an end. Another sentence follows it, as they do in paragraphs."
_B = "A second paragraph holds more of the same: statements, details and numbers such as 42. It is as long as text in an article usually is, or somewhat longer than that."
_C = "Short closing line."
_D = "name one | name two | name three | name four | and so on through the table without any mark of a sentence " * 3
_MENU = "".join(f'<li><a href="/{x}">{x}</a></li>' for x in ("Home", "News", "About us", "Contact", "Shop"))
_LINKS = "".join(f'<a href="/r{i}">Another story number {i} that you may like</a> ' for i in range(4))
_LINKED = '<a href="/x">a long link text that makes most of this paragraph, as links at times do</a>'

PAGES = [
    f'<body><nav><ul>{_MENU}</ul></nav><div class="ad">Buy now, it is cheap today.</div><article data-main="1"><h1>Title of it</h1><p>{_A}</p><p>{_B}</p><p>{_C}</p></article><footer>&copy; 2020 example.org. All rights reserved by the owner of this place, and so on.</footer></body>',
    f'<body><header><h2>Site name</h2><ul class="menu">{_MENU}</ul></header><div id="wrapper"><div id="content" data-main="1"><h1>Heading</h1><p>{_B}<p>{_A}<ul><li>First point of the list, in words.</li><li>Second point.</li></ul></div><div id="sidebar"><h3>Recent posts</h3>{_LINKS}<p>{_A}</p></div></div><div id="footer"><p>{_C}</p></div></body>',
    f'<body><div class="cookie-notice"><p>We use cookies to make this site better. By going on you agree to our policy, which is long.</p><button>OK</button></div><main><section class="story" data-main="1"><h1>News</h1><h2>Lead in</h2><p>{_A}</p><blockquote><p>{_B}</p></blockquote><p>{_C}</p></section><section class="comments"><h3>Comments</h3><div class="comment"><p>{_A}</p></div><div class="comment"><p>I do not agree with this at all, sorry.</p></div></section></main><footer><ul>{_MENU}</ul></footer></body>',
    f'<body><table><tr><td class="nav">{_LINKS}</td><td class="text" data-main="1"><h1>Old page</h1><p>{_A}</p><p>{_B}</p></td><td class="right"><p>Advertisement: {_C}</p></td></tr></table></body>',
    f'<body><header class="site-header"><p>The daily paper of the town</p></header><article data-main="1"><header><h1>Story</h1></header><p>{_B}</p><div class="share" data-main="0"><ul>{_MENU}</ul></div><p>{_A}</p><aside class="related" data-main="0"><h4>Read more</h4>{_LINKS}<p>{_B}</p></aside><p>{_A}</p><form class="newsletter" data-main="0"><p>Sign up for our letter and get it every week in your mail.</p><input type="text"><label>Mail</label></form></article><aside><h3>Most read</h3>{_LINKS}</aside><footer><p>{_A}</p></footer></body>',
    f'<body><div class="topbar"><a href="/">Docs</a> <a href="/api">API</a></div><div class="layout"><div class="toc"><ul>{_MENU}</ul></div><div class="markdown-body" data-main="1"><h1>Guide</h1><p>{_A}</p><pre>x = 1\ny = 2</pre><h2>Next part</h2><p>{_B}</p><ol><li>Do this first and then wait.</li><li>Do that.</li></ol><table><tr><td>cell one</td><td>cell two</td></tr></table></div></div><div class="footer">{_LINKS}</div></body>',
    f'<body><nav class="breadcrumb"><a href="/">Home</a> &gt; <a href="/x">Part</a></nav><main data-main="1"><h1>Recipe</h1><p>{_C}</p><p>{_A}</p><figure><img src="x.png"><figcaption>What the picture shows.</figcaption></figure><p>{_B}</p></main><div id="comments"><h2>3 comments</h2><ol><li><p>{_A}</p></li><li><p>{_B}</p></li><li><p>{_C}</p></li></ol><form><p>Leave a reply; your address is not shown.</p><textarea>text</textarea></form></div></body>',
    f'<body><div class="header"><h1>Shop</h1></div><div class="menu"><ul>{_MENU}</ul></div><form action="/login"><p>Log in with your name and your word to go on.</p><label>Name</label><input></form><div class="promo"><p>{_A}</p></div><div class="footer"><p>{_C}</p></div></body>',
    f'<body><div class="page"><div class="banner">{_C}</div><div class="post"><h2 class="post-title" data-main="1">Entry</h2><div class="meta"><span>By someone</span> <a href="/u">u</a></div><div class="entry-content" data-main="1"><p>{_A}</p><p>{_B}</p><div class="ad" data-main="0"><p>{_A}</p></div><p>{_A}</p></div></div><div class="widget"><h3>Tags</h3>{_LINKS}</div></div></body>',
    f'<body><nav><ul>{_MENU}</ul></nav><div class="ad">{_C}</div><article data-main="1"><h1>Rows</h1><p>{_D}</p><p>{_D}<p>one one one one</p></article><footer>{_A}</footer></body>',
    f'<body><div class="top"><ul>{_MENU}</ul></div><article data-main="1"><h1>list of words</h1><p>{_D}</p></article><div class="bottom"><p>{_B}</p></div></body>',
    f'<body><nav><ul>{_MENU}</ul></nav><article data-main="1"><h1>Tiny</h1><p>{_C}</p></article><div class="ads"><p>{_B}</p></div><footer>{_C}</footer></body>',
    f'<body><ul>{_MENU}</ul><div data-main="1"><h1>Plain</h1><p>{_A}<p>{_B}<p>{_A}<p>{_C}</div><ul>{_MENU}</ul><p class="copyright">&copy; someone</p></body>',
    f'<body><header><nav><ul>{_MENU}</ul></nav></header><article data-main="1"><h1>T</h1><section><h2>Part one</h2><p>{_A}</p><p>{_B}</p></section><section><h2>Part two</h2><p>{_B}</p></section><footer data-main="0"><p>Filed under things.</p></footer></article><section id="disqus" class="discussion"><article class="comment"><p>{_B}</p></article><article class="comment"><p>{_A}</p></article></section><div role="complementary"><p>{_A}</p></div><div class="notice"><p>{_B}</p></div></body>',
    f'<div class="menu"><ul>{_MENU}</ul></div><article data-main="1"><p>{_C}</p><p>It is short, this one too.</p><form data-main="0"><p>Give your name, please, and send.</p><label>Name</label></form></article><section class="comments"><article class="comment"><p>{_C}</p></article></section>',
    f'<body><nav>{_LINKS}</nav><main data-main="1"><p>Text of medium length in a plain page here.</p><p>And a line more, no heading at all.</p></main><footer><p>Text of medium length in the footer, too.</p></footer></body>',
    f'<body><div id="nav">{_LINKS}</div><article data-main="1"><p>Some words in a row, sixty letters or so in this one.</p><h2>part</h2><p>Ok</p><form data-main="0"><p>{_A}</p><p>Send</p></form><p>{_A}</p></article><aside><p>{_C}</p><p>{_A}</p></aside><div class="cookie"><p>{_C}</p></div></body>',
    f'<body><nav><ul>{_MENU}</ul></nav><div data-main="1"><h1>Head</h1><p>{_C}</p><p>A line that is not very long, with marks; as it goes.</p></div><footer><p>{_C}</p></footer></body>',
    f'<body><header><a href="/">Site</a></header><div data-main="1"><h2>Part</h2><p>{_A}</p><p>{_C}</p><h3>Next</h3><p>{_B}</p></div><div class="footer"><p>{_C}</p></div></body>',
    f'<body><h1 data-main="1">Bare page</h1><p data-main="1">{_A}</p><p data-main="1">{_C}</p><p data-main="1">{_B}</p><div class="footer"><p>{_C}</p></div></body>',
    f'<p data-main="1">{_B}</p><p data-main="1">Second line here, as well.</p><p data-main="1">{_A}</p>',
    f'<body><p data-main="1">Plain text of a page with nothing around it, in a sentence.</p><p data-main="1">One more, also short.</p></body>',
    f'<body><nav><ul>{_MENU}</ul></nav><p data-main="1">{_A}</p><ul data-main="1"><li>A point of the text, without links.</li><li>Another point.</li></ul><p data-main="1">{_B}</p><footer><p>{_C}</p></footer></body>',
    f'<body><main><div data-main="1"><p>{_C}</p><p>{_A}</p><p>{_B}</p></div><aside><p>{_A}</p>{_LINKS}</aside></main></body>',
    f'<body><header><p>Site of the house</p></header><main><div data-main="1"><h2>Part</h2><p>Para of few words.</p></div><aside><p>Read this other thing, too.</p></aside></main><footer><p>{_B}</p></footer></body>',
    f'<body><nav><ul>{_MENU}</ul></nav><article data-main="1"><p>See {_LINKED}.</p><p>{_A}</p><p>{_LINKED}</p><ul><li><a href="/s">A source of the text, which is named here</a></li><li>{_C}</li></ul></article><footer>{_LINKS}</footer></body>',
    f'<body><div data-main="1"><p>In this one {_LINKED}, and that.</p><p>{_A}</p></div><div class="related">{_LINKS}</div><div class="menu"><ul>{_MENU}</ul></div></body>',
    f'<body><div data-main="1"><p>{_A}</p><table><tr><th>Name</th><th>Count</th></tr><tr><td>one</td><td>12</td></tr></table><p>{_C}</p></div><ul>{_MENU}</ul></body>',
    f'<body><ul>{_MENU}</ul><div data-main="1">{_A}</div><div data-main="1">{_C}</div><div data-main="1">{_B}</div><div class="footer">{_C}</div></body>',
    f'<body><nav><ul>{_MENU}</ul></nav><div data-main="1"><h1>Boxes</h1><div>{_B}</div><div>Some words in a box, not many.</div><div>{_A}</div></div><div class="copyright">{_A}</div></body>',
    f'<body data-main="1">{_C}<br>{_A}<hr>{_B}<hr>A last line of it.</body>',
    f'<body data-main="1">Text with nothing around it, in a sentence.<p>{_A}</p>{_C}<div class="footer" data-main="0">{_C}</div></body>',
    f'<body><nav>{_LINKS}</nav><main data-main="1"><h1>List</h1><dl><dt>Word</dt><dd>{_C}</dd><dt>Longer word</dt><dd>{_A}</dd></dl></main><footer>Since 2001.</footer></body>',
    f'<body><header><a href="/">Site</a></header><article data-main="1"><dl><dt>Name</dt><dd>What it stands for.</dd><dt>Size</dt><dd>{_B}</dd></dl><p>{_C}</p></article><div class="footer"><p>{_A}</p></div></body>',
    f'<body><article data-main="1"><h1>Part</h1><p>{_A}</p><aside data-main="0">See also: <a href="/s">A further text</a></aside><p>{_B}</p><aside data-main="0"><p>{_C}</p></aside></article></body>',
    f'<body><nav>{_LINKS}</nav><article data-main="1"><header><h1>Head of it</h1><p data-main="0">Written by A. Person on 1 March</p></header><p>{_A}</p><p>{_C}</p></article><footer><p>{_C}</p></footer></body>',
    f'<article data-main="1"><header><h2>Head</h2><p data-main="0">From our writer, {_C}</p></header><p>{_B}</p></article>',
    f'<body><table><tr><td colspan="2"><a href="/">Site</a></td></tr><tr><td>{_LINKS}</td><td data-main="1"><h2>Part</h2><p>{_A}</p><p>{_C}</p></td></tr><tr><td colspan="2">&copy; someone</td></tr></table></body>',
    f'<body><table><tr><td><ul>{_MENU}</ul></td><td data-main="1"><p>A cell holds the text of this page, as it once was done.</p><p>{_A}</p><p>One more line.</p></td></tr></table></body>',
]
