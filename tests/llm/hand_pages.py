"""Hand-written pages, of kinds that the generator of labelled pages can't make, with their main text. The model
was looked at with those of PAGES, not with those of UNSEEN."""

PAGES = {
    'bare': (
        '<html><body><h1>How to sharpen a knife</h1><p>Start with a coarse stone. Wet it first.</p><p>Hold the blade at twenty degrees and draw it towards you.</p><p>Repeat on a finer stone, then strop it.</p></body></html>',
        'How to sharpen a knife Start with a coarse stone. Wet it first. Hold the blade at twenty degrees and draw it towards you. Repeat on a finer stone, then strop it.',
    ),
    'bare with links': (
        '<html><head><title>x</title></head><body><p><a href=/>Home</a> | <a href=/a>About</a> | <a href=/c>Contact</a></p><h1>The ferry strike ends</h1><p>After nine days the crews went back to work on Monday, the union said.</p><p>Sailings resume at noon, with a reduced timetable until Thursday.</p><p>Copyright 2011 Harbour Gazette. All rights reserved.</p></body></html>',
        'The ferry strike ends After nine days the crews went back to work on Monday, the union said. Sailings resume at noon, with a reduced timetable until Thursday.',
    ),
    'unnamed divs': (
        '<body><div><a href=/>Start</a> <a href=/n>News</a> <a href=/s>Sport</a> <a href=/w>Weather</a></div><div><h1>Snow closes the pass</h1><p>The road over the pass was closed on Friday night, police said. It may stay shut until Sunday.</p><p>Drivers should take the tunnel, where a toll is charged, or wait.</p></div><div>&copy; 2020 Valley Media</div></body>',
        'Snow closes the pass The road over the pass was closed on Friday night, police said. It may stay shut until Sunday. Drivers should take the tunnel, where a toll is charged, or wait.',
    ),
    'table': (
        '<body><table width=100%><tr><td colspan=2><a href=/><img src=logo.gif alt=Logo></a></td></tr><tr><td width=140><a href=/1>Products</a><br><a href=/2>Support</a><br><a href=/3>Downloads</a><br><a href=/4>Jobs</a></td><td valign=top><h1>Release notes</h1><p>This version fixes a crash on start. It also loads large files faster, and prints in colour.</p><p>Users of the old format must convert their files first.</p></td></tr><tr><td colspan=2>Copyright 1999 Acme Inc.</td></tr></table></body>',
        'Release notes This version fixes a crash on start. It also loads large files faster, and prints in colour. Users of the old format must convert their files first.',
    ),
    'list of links': (
        '<body><nav><a href=/>Home</a></nav><article><h1>Ten books for the summer</h1><p>Our editors chose these.</p><ul><li><a href=/1>The Long Road</a></li><li><a href=/2>Night Swim</a></li><li><a href=/3>A Year of Bread</a></li></ul></article><footer>Imprint</footer></body>',
        'Ten books for the summer Our editors chose these. The Long Road Night Swim A Year of Bread',
    ),
    'byline and code': (
        '<body><header><a href=/>dev notes</a></header><main><article><h1>Reverse a list</h1><div class=byline>By J. Doe, 3 May 2019</div><p>Use a slice:</p><pre><code>xs[::-1]\nprint(xs)</code></pre><p>That copies the list, so mind the memory.</p></article></main><aside><h2>Tags</h2><a href=/t>python</a></aside></body>',
        'Reverse a list By J. Doe, 3 May 2019 Use a slice: xs[::-1] print(xs) That copies the list, so mind the memory.',
    ),
    'blog': (
        "<body><div id=header><h2><a href=/>My blog</a></h2></div><div id=sidebar><h3>Archive</h3><ul><li><a href=/1>May</a><li><a href=/2>June</a></ul></div><div class='post hentry'><h1 class=entry-title>Moving house</h1><div class=entry-content><p>We packed for a week, and lost the cat twice.</p><p>It is quiet here. I like the garden.</p></div></div><div id=comments><h3>2 comments</h3><ol><li><p>Good luck in the new place!</p></li><li><p>Poor cat, is it well again?</p></li></ol></div><div id=footer>Powered by words</div></body>",
        'Moving house We packed for a week, and lost the cat twice. It is quiet here. I like the garden.',
    ),
    'newspaper': (
        "<body><div class='cookie-banner'><p>We value your privacy. By going on you accept cookies.</p><button>Accept</button></div><header class=masthead><p>The Daily Post</p><nav><ul><li><a href=/a>World</a></li><li><a href=/b>Money</a></li></ul></nav></header><main id=main><article><header><h1>Rates held again</h1><p>The bank sees no need to act.</p></header><section><p>The central bank left rates unchanged on Tuesday, as most had expected.</p><div class='ad-slot'><p>Save up to half on shoes this week!</p></div><p>Two members voted for a cut.</p><blockquote>We are patient, the governor said.</blockquote></section></article><aside class=related><h3>More on this</h3><ul><li><a href=/x>Why rates matter</a></li></ul></aside></main><form action=/n><label>Get our letter</label><input name=e></form><footer><p>Printed on recycled electrons. Contact the editor.</p></footer></body>",
        'Rates held again The bank sees no need to act. The central bank left rates unchanged on Tuesday, as most had expected. Two members voted for a cut. We are patient, the governor said.',
    ),
    'text in the body': (
        '<body><a href=/>up</a><h1>Notes on a walk</h1>We left at dawn and it rained.<br><br>By noon the sky had cleared, and we saw the sea.<p>Then home by train.</body>',
        'Notes on a walk We left at dawn and it rained. By noon the sky had cleared, and we saw the sea. Then home by train.',
    ),
    'german': (
        '<body><div id=nav><a href=/>Start</a> &middot; <a href=/k>Kontakt</a></div><div id=content><h1>Gr&uuml;ne W&auml;lder</h1><p>Der Wald w&auml;chst&nbsp;wieder, sagt das Amt.</p><p>Vor allem Buchen &amp; Eichen.</p></div><div id=footer>Impressum | Datenschutz</div></body>',
        'Grüne Wälder Der Wald wächst wieder, sagt das Amt. Vor allem Buchen & Eichen.',
    ),
    'nested unnamed': (
        '<body><div><div><div><a href=/>Logo</a></div><div><ul><li><a href=/1>One</a></li><li><a href=/2>Two</a></li><li><a href=/3>Three</a></li></ul></div></div><div><div><h1>Bridge reopens</h1><div><p>The old bridge was repaired in record time. Cars may cross from today.</p><p>Cyclists must still dismount, a sign says.</p></div></div></div><div><p>© City Council</p></div></div></body>',
        'Bridge reopens The old bridge was repaired in record time. Cars may cross from today. Cyclists must still dismount, a sign says.',
    ),
    'no heading': (
        '<body><ul><li><a href=/>Home</a></li><li><a href=/b>Blog</a></li></ul><div><p>Dear readers, this site will move next month. Please change your bookmarks, and tell your friends about it.</p><p>The old address will work until the end of the year.</p></div><p>Copyright 2015 by us</p></body>',
        'Dear readers, this site will move next month. Please change your bookmarks, and tell your friends about it. The old address will work until the end of the year.',
    ),
    'wiki': (
        '<body><div id=mw-head><div class=menu><ul><li><a href=/t>Talk</a></li><li><a href=/e>Edit</a></li></ul></div><form id=search><input name=s></form></div><div id=content class=body-text role=main><h1>Alder</h1><p>An <b>alder</b> is a tree of the <a href=/birch>birch</a> family.</p><h2>Uses</h2><ul><li>Smoking <a href=/fish>fish</a></li><li>Clogs</li></ul><table><tr><th>Height</th><td>25 m</td></tr><tr><th>Age</th><td>60 years</td></tr></table></div><div id=footer><ul><li><a href=/p>Privacy</a></li></ul></div></body>',
        'Alder An alder is a tree of the birch family. Uses Smoking fish Clogs Height 25 m Age 60 years',
    ),
}

UNSEEN = {
    'recipe': (
        "<body><div class=topbar><a href=/>Kitchen</a></div><div class=container><div class=recipe><h1>Onion soup</h1><p>Slice six onions thinly. Fry them slowly in butter, for an hour.</p><ol><li>Add a spoon of flour.</li><li>Pour in the stock and simmer.</li></ol><p>Serve with toast.</p></div><div class='widget newsletter'><p>Get a recipe every week.</p><form action=/n><input name=m><button>Join</button></form></div></div><div class=footer-links><a href=/t>Terms</a> <a href=/p>Privacy</a></div></body>",
        'Onion soup Slice six onions thinly. Fry them slowly in butter, for an hour. Add a spoon of flour. Pour in the stock and simmer. Serve with toast.',
    ),
    'forum-like': (
        '<body><nav class=breadcrumb><a href=/>Home</a> &gt; <a href=/g>Guides</a></nav><main><h1>Fit a bicycle tyre</h1><p>Let the air out, then lever one side off the rim.</p><p>Put the new tube in, and push the bead back by hand.</p></main><section class=comments><article class=comment><p>Worked the first time, cheers.</p></article><article class=comment><p>Mind the valve!</p></article></section></body>',
        'Fit a bicycle tyre Let the air out, then lever one side off the rim. Put the new tube in, and push the bead back by hand.',
    ),
    'old table': (
        '<body bgcolor=white><center><a href=/>Index</a> - <a href=/l>Links</a> - <a href=/m>Mail</a></center><hr><table><tr><td><h1>The lighthouse</h1><p>It was built in 1811, of granite from the island.</p><p>The last keeper left in 1988, when the lamp was automated.</p></td></tr></table><hr><small>Copyright 1997 J. Smith</small></body>',
        'The lighthouse It was built in 1811, of granite from the island. The last keeper left in 1988, when the lamp was automated.',
    ),
    'hidden and raw': (
        "<body><noscript><p>Please enable scripts.</p></noscript><article><h1>A &lt;b&gt; tag</h1><p>It makes text bold&hellip; if a &lt; b, that is.</p><template><p>never shown</p></template><svg><text>logo</text></svg><p>Use &amp;lt; to write it.</p></article><script>if (a < b) document.write('<p>no</p>')</script></body>",
        'A <b> tag It makes text bold… if a < b, that is. Use &lt; to write it.',
    ),
}
