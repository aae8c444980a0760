"""Small pages with the main text marked by hand (data-main), for the page model to learn from.

Fixed values: invented pages in the manner of news sites, blogs, shops, manuals and forums.
"""

_LEAD = (
    "The river rose again on Monday, and the town prepared for another long night. "
    "Volunteers carried sand to the old bridge, while the council met twice."
)
_MORE = (
    "Nobody had expected the water to come so early in the year, said one of them. "
    "In the valley the fields are still wet, and most farmers will have to sow later than usual."
)
_END = "The next report is due on Friday; until then, the road to the mill stays closed."

LABELLED = [
    f"""<html><head><title>River</title><style>p{{}}</style></head><body>
<nav><ul><li><a href="/">Home</a></li><li><a href="/news">News</a></li><li><a href="/sport">Sport</a></li></ul></nav>
<div class="ad">Buy two boats, get one free today.</div>
<article data-main><h1>River rises</h1><p>{_LEAD}</p><p>{_MORE}</p><p>{_END}</p></article>
<footer>&copy; 2020 &middot; <a href="/imprint">Imprint</a></footer></body></html>""",
    f"""<body><header><div class="logo">The Valley Paper</div><form action="/search"><input><button>Search</button></form></header>
<div class="menu"><a href="/a">Politics</a> <a href="/b">Culture</a> <a href="/c">Weather</a></div>
<div id="content"><div class="post" data-main><h2>After the flood</h2><p>{_LEAD}</p><blockquote>{_MORE}</blockquote><p>{_END}</p></div>
<div class="comments"><h3>3 comments</h3><div class="comment"><p>I was there on Monday, and it was worse than they say in this article.</p></div>
<div class="comment"><p>Thank you for the report, the photos are very good as well.</p></div></div></div>
<div class="sidebar"><h4>Most read</h4><ul><li><a href="/1">Ten easy soups</a></li><li><a href="/2">The new mayor</a></li></ul></div>
<div id="footer"><p>All rights reserved. Contact us by post or by telephone.</p></div></body>""",
    f"""<body><div class="cookie-notice">We use cookies to improve this site. By going on, you agree. <button>Accept</button></div>
<main data-main><h1>How to dry a cellar</h1><p>{_MORE}</p><h2>First steps</h2><p>{_LEAD}</p><ul><li>Open all windows, even in winter.</li><li>Lift the carpets, and let them dry outside.</li></ul><p>{_END}</p></main>
<aside><p>Subscribe to our letter and get news from the valley every week.</p><form><input><button>Subscribe</button></form></aside>
<footer><ul><li><a href="/terms">Terms</a></li><li><a href="/privacy">Privacy</a></li></ul></footer></body>""",
    f"""<body><table class="nav"><tr><td><a href="/x">Start</a></td><td><a href="/y">Archive</a></td></tr></table>
<article data-main><header><h1>Letters from the mill</h1></header><section><p>{_LEAD}</p><p>{_MORE}</p></section><section><h2>What follows</h2><p>{_END}</p><pre>level = 3.2 m</pre></section></article>
<section class="related"><h3>Related</h3><a href="/r1">Bridge closed</a> <a href="/r2">Sand is scarce</a></section>
<section id="comments"><p>Anna: the road was closed on Sunday already, as far as I remember.</p></section>
<div class="share">Share this on all the networks that you use.</div></body>""",
    f"""<body><div id="banner">Special offer: 20 % off all boots until Sunday!</div><div class="wrapper"><div class="breadcrumb"><a href="/">Home</a> / <a href="/n">News</a></div>
<div class="entry-content" data-main><p>{_LEAD}</p><figure><img src="a.jpg"><figcaption>The bridge on Monday evening.</figcaption></figure><p>{_MORE}</p><p>{_END}</p></div>
<div class="promo"><p>Our book on the great flood is in the shops now, with many pictures.</p></div>
<form class="newsletter"><p>Your address is never given to anybody else.</p><input><button>Send</button></form></div></body>""",
    f"""<body><nav class="top"><a href="/">Forum</a><a href="/help">Help</a></nav><div class="notice">The forum will be closed for repairs on Saturday morning.</div>
<article data-main><h1>Report</h1><p>{_LEAD}</p><div><p>{_MORE}</p></div><table><tr><th>Day</th><th>Level</th></tr><tr><td>Monday</td><td>3.2 m</td></tr></table><p>{_END}</p></article>
<aside class="sidebar"><h4>Tags</h4><a href="/t1">river</a><a href="/t2">bridge</a></aside>
<div class="comment-list"><ol><li><p>It was on the radio, too, but only very late in the evening.</p></li><li><p>We still have no electricity in our street, by the way.</p></li></ol></div>
<footer><p>Made in the valley.</p></footer></body>""",
    f"""<body><article data-main><h1>Short note</h1><p>{_END}</p><div class="ad">Cheap pumps, delivered in one day.</div><p>{_LEAD}</p><nav><a href="/p">Previous</a><a href="/n">Next</a></nav><p>{_MORE}</p><section class="comments"><p>This is what my grandfather used to say about the river as well.</p></section></article><footer>Imprint</footer></body>""",
]
