"""Hand-written pages in layouts of their own, each with the text that is its article."""

GOLD = {
    "cookies are the topic": (
        "<div class=content><h1>Cookies</h1>" + "<p>Mix the cookie dough and bake one cookie.</p>" * 5 + "</div>",
        ["Cookies"] + ["Mix the cookie dough and bake one cookie."] * 5,
    ),
    "a short article beside an aside": ("<article><p>Press &lt;Enter&gt; now.</p><aside>Related: more</aside></article>", ["Press <Enter> now."]),
    "copyright is the topic": (
        "<html><body><header><a href=/>Law blog</a></header><main><h1>Copyright in short</h1><p>Copyright protects a work from the day it is made.</p><p>All rights stay with its author, unless a contract says otherwise.</p></main>"
        "<footer>Copyright 2024 Law blog. All rights reserved.</footer></body></html>",
        ["Copyright in short", "Copyright protects a work from the day it is made.", "All rights stay with its author, unless a contract says otherwise."],
    ),
    "cookies without any container": (
        "<html><body><h1>Why browsers keep a cookie</h1><p>A cookie is a small text that a site leaves behind.</p><p>The next request sends the cookie back, so the site knows who asks.</p><p>Without a cookie each request would be the first.</p></body></html>",
        ["Why browsers keep a cookie", "A cookie is a small text that a site leaves behind.", "The next request sends the cookie back, so the site knows who asks.", "Without a cookie each request would be the first."],
    ),
    "a blog post": (
        "<body><div id=masthead><h2><a href='/'>My days</a></h2><ul><li><a href=/a>About</a><li><a href=/c>Contact</a></ul></div><div class='post'><h2>A walk in the hills</h2><p>We left at seven in the morning, when the fog was still low.</p>"
        "<p>By noon we could see the lake, and both of us were hungry.</p></div><div class=comments><h3>2 replies</h3><div class=comment><p>Lovely photos, thank you for sharing them with us!</p></div><div class=comment><p>Which path did you take down?</p></div></div></body>",
        ["A walk in the hills", "We left at seven in the morning, when the fog was still low.", "By noon we could see the lake, and both of us were hungry."],
    ),
    "news with adverts inside": (
        "<html><body><nav><a href=1>World</a> <a href=2>Sport</a> <a href=3>Weather</a></nav><article><h1>Bridge opens after three years</h1><p>The new bridge over the river opened to traffic on Monday morning.</p><div class=\"ad-slot\"><p>Buy two tyres and get two more for free, this week only!</p></div>"
        "<p>Builders had found the old piers weaker than expected, the mayor said.</p><p>The work cost twelve million in all.</p></article><aside class=related><h3>More news</h3><ul><li><a href=4>Ferry service ends</a><li><a href=5>Road tax rises</a></ul></aside></body></html>",
        ["Bridge opens after three years", "The new bridge over the river opened to traffic on Monday morning.", "Builders had found the old piers weaker than expected, the mayor said.", "The work cost twelve million in all."],
    ),
    "a recipe with lists": (
        "<main><h1>Bread</h1><h2>You need</h2><ul><li>500 g of flour</li><li>300 ml of water</li><li>10 g of salt</li></ul><h2>What to do</h2><ol><li>Mix all of it and wait for an hour.</li><li>Bake it for forty minutes.</li></ol></main><footer><p>Made with love.</p></footer>",
        ["Bread", "You need", "500 g of flour", "300 ml of water", "10 g of salt", "What to do", "Mix all of it and wait for an hour.", "Bake it for forty minutes."],
    ),
    "tables and quotes": (
        "<article><h1>Rain in spring</h1><p>The table shows what fell in each month.</p><table><tr><th>Month</th><th>Rain</th></tr><tr><td>March</td><td>40 mm</td></tr></table><blockquote><p>It was the driest spring that I remember, says a farmer.</p></blockquote></article>",
        ["Rain in spring", "The table shows what fell in each month.", "Month", "Rain", "March", "40 mm", "It was the driest spring that I remember, says a farmer."],
    ),
    "a notice before the text": (
        "<body><div class='cookie-banner'><p>We use cookies to make this site better for you. Read our cookie policy.</p><button>Accept</button></div><div class=entry-content><p>The museum is open from nine to five on all days but Monday.</p><p>Children enter for free.</p></div></body>",
        ["The museum is open from nine to five on all days but Monday.", "Children enter for free."],
    ),
    "a newsletter form in the middle": (
        "<article><h1>How bees find home</h1><p>Bees remember the place of the sun and the shape of the land.</p><section class=newsletter><p>Get our letter each Friday.</p><form><label>Your mail</label><button>Send</button></form></section><p>On cloudy days they see the light's direction instead.</p></article>",
        ["How bees find home", "Bees remember the place of the sun and the shape of the land.", "On cloudy days they see the light's direction instead."],
    ),
    "paragraphs by line breaks": (
        "<div id=content><h1>Letter</h1>Dear readers,<br>the library moves next month.<p>All books have to be back by then.</div><div id=footer>Library of the town</div>",
        ["Letter", "Dear readers, the library moves next month.", "All books have to be back by then."],
    ),
    "references and odd spaces": (
        "<article><p>Fish &amp; chips\n\t cost&nbsp;5&#8364; &ndash; not 6&#x20AC;.</p><p>   </p><p>&quot;Good&quot;, they said.</p></article>",
        ["Fish & chips cost 5€ – not 6€.", "\"Good\", they said."],
    ),
    "scripts, styles and comments": (
        "<html><head><style>p{color:red}</style><script>document.write('<p>no</p>')</script></head><body><!-- <p>not this</p> --><main><p>Only this sentence is text.</p><script>var x = \"<p>nor this</p>\";</script></main><noscript><img src=x></noscript></body></html>",
        ["Only this sentence is text."],
    ),
    "no article at all": ("<body><nav><ul><li><a href=/>Home</a></li><li><a href=/b>Blog</a></li></ul></nav><footer>&copy; 2020 Someone</footer></body>", []),
    "only an advert": ("<div class=advert>Best prices in town, call us now!</div>", []),
    "sidebar first": (
        "<body><div class=sidebar><h3>Tags</h3><ul><li><a href=1>birds</a><li><a href=2>trees</a></ul></div><div class=main-content><h1>The oak</h1><p>An oak can live for a thousand years and feeds hundreds of kinds of insects.</p></div></body>",
        ["The oak", "An oak can live for a thousand years and feeds hundreds of kinds of insects."],
    ),
    "nested containers": (
        "<div id=wrapper><div class=page><div class=row><div class=col><article class=entry><header><h1>On patience</h1></header><div><p>It is said that patience grows with age, but I doubt it.</p></div></article></div></div></div><div class=site-footer><p>Imprint and privacy</p></div></div>",
        ["On patience", "It is said that patience grows with age, but I doubt it."],
    ),
    "a German page": (
        "<html lang=de><body><nav class=menu><ul><li><a href=a>Start</a><li><a href=b>Verein</a></ul></nav><main><h1>Der Garten im Winter</h1><p>Im Winter ruht der Garten, doch einige Vögel bleiben.</p><p>Wer sie füttert, sieht sie jeden Morgen.</p></main><footer>© Gartenverein</footer></body></html>",
        ["Der Garten im Winter", "Im Winter ruht der Garten, doch einige Vögel bleiben.", "Wer sie füttert, sieht sie jeden Morgen."],
    ),
    "unclosed paragraphs": ("<html><body><article><h1>Notes<p>First note of the day.<p>Second note, somewhat longer than the first one.<p>Third.</article>", ["Notes", "First note of the day.", "Second note, somewhat longer than the first one.", "Third."]),
    "comments as articles": (
        "<main><article><h1>Free buses</h1><p>From May on, buses are free on Sundays.</p></article></main><section id=comments><article class=comment><p>About time, I have waited for this for years.</p></article><article class=comment><p>Who pays for it in the end?</p></article></section>",
        ["Free buses", "From May on, buses are free on Sundays."],
    ),
    "code in a page": ("<article><h2>Listing files</h2><p>This command lists files:</p><pre>ls -l /tmp</pre><p>It is that simple.</p></article><form class=search><label>Search:</label><button>Go</button></form>", ["Listing files", "This command lists files:", "ls -l /tmp", "It is that simple."]),
    "breadcrumbs and share links": (
        "<body><div class=breadcrumb><a href=/>Home</a> &gt; <a href=/t>Travel</a></div><div class=article-body><h1>Night trains</h1><p>More and more people take the train by night again.</p><p>New lines join Paris, Berlin and Vienna.</p></div><div class=social-share><a href=x>Share</a> <a href=y>Mail</a></div></body>",
        ["Night trains", "More and more people take the train by night again.", "New lines join Paris, Berlin and Vienna."],
    ),
    "one word": ("<html><body><main><p>Closed.</p></main></body></html>", ["Closed."]),
    "a login page": ("<body><div class=login><form><label>Name</label><label>Password</label><button>Sign in</button></form></div><footer>&copy; Shop</footer></body>", []),
}
