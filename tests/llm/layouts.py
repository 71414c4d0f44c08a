"""Pages written by hand, none of them from the module's generator: pairs of html and the blocks of main text.

``{L}``, ``{M}`` and ``{S}`` stand for a long, a middling and a short paragraph, numbered as they come.
"""

import itertools
import re

LONG = (
    "The river had risen overnight, and by morning the lower meadows were under water. Farmers moved their cattle to the hills, while the council met to decide whether the old bridge could still be used.",
    "Researchers followed four hundred families over twelve years, and found that reading aloud made less of a difference than talk at the table. The effect was small, they say, but it held in every town they looked at.",
    "To replace the filter, first shut off the pump and wait until the pressure gauge reads zero. Then loosen the three bolts by hand, lift the cover straight up, and clean the seal before you put in the new cartridge.",
    "She left the firm in spring, after nine years as its chief designer, and opened a small workshop by the harbour. Within a season she had more orders than she could fill, most of them from abroad.",
    "Prices rose again in the third quarter, though more slowly than many had feared. Economists point to cheaper energy, a mild winter, and to households that put off buying cars and furniture.",
    "No one knows who built the wall, or why it ends so suddenly in the middle of the field. Local stories speak of a quarrel between brothers; the stones themselves say nothing.",
)
MIDDLE = ("The vote was closer than expected, and two members abstained.", "It took the crew most of a day to reach the hut.", "Only one of the four samples showed any change at all.", "Critics liked the second act, but not the ending.", "He answered every letter himself until last year.")
SHORT = ("It rained.", "Nobody came.", "Then it was over.", "That was all.")
MENU = "<ul><li><a href=/>Home</a></li><li><a href=/n>News</a></li><li><a href=/c>Contact</a></li><li><a href=/a>About us</a></li></ul>"
FOOT = "<p>&copy; 2024 Harbour Post. All rights reserved.</p>"

PAGES = [
    # grids, utility classes and hashed names
    ("<body><nav>{MENU}</nav><div class='col-md-9'><h1>Flood in the valley</h1><p>{L}</p><p>{L}</p><p>{S}</p></div><footer>{FOOT}</footer>", ["Flood in the valley", "{L}", "{L}", "{S}"]),
    ("<body><nav>{MENU}</nav><div class='col'><h1>Flood in the valley</h1><p>{L}</p><p>{L}</p><p>{S}</p></div><footer>{FOOT}</footer>", ["Flood in the valley", "{L}", "{L}", "{S}"]),
    ("<body><nav>{MENU}</nav><div class='css-1x2y3z'><h1>Flood in the valley</h1><p>{L}</p><p>{L}</p><p>{S}</p></div><footer>{FOOT}</footer>", ["Flood in the valley", "{L}", "{L}", "{S}"]),
    ("<body><nav>{MENU}</nav><div class='jsx-123'><h1>Flood in the valley</h1><p>{L}</p><p>{L}</p><p>{S}</p></div><footer>{FOOT}</footer>", ["Flood in the valley", "{L}", "{L}", "{S}"]),
    ("<body><nav>{MENU}</nav><div class='flex grow'><h1>Flood in the valley</h1><p>{L}</p><p>{L}</p><p>{S}</p></div><footer>{FOOT}</footer>", ["Flood in the valley", "{L}", "{L}", "{S}"]),
    ("<body><nav>{MENU}</nav><div class='px-4 py-2'><h1>Flood in the valley</h1><p>{L}</p><p>{L}</p><p>{S}</p></div><footer>{FOOT}</footer>", ["Flood in the valley", "{L}", "{L}", "{S}"]),
    ("<body><nav>{MENU}</nav><div class='mw-body'><h1>Flood in the valley</h1><p>{L}</p><p>{L}</p><p>{S}</p></div><footer>{FOOT}</footer>", ["Flood in the valley", "{L}", "{L}", "{S}"]),
    ("<body><div id=__next><div class=sc-bdVaJa><header class=sc-htpNat>{MENU}</header><div class=sc-bwzfXH><h1>What tables teach</h1><p>{L}</p><p>{M}</p><p>{L}</p></div><div class=sc-ifAKCX>{FOOT}</div></div></div>", ["What tables teach", "{L}", "{M}", "{L}"]),
    ("<body class='bg-white'><div class='max-w-7xl mx-auto'><div class='flex justify-between'>{MENU}</div><div class='prose lg:prose-xl'><h1>Changing the filter</h1><p>{L}</p><h2>Before you start</h2><p>{M}</p><p>{L}</p></div></div>", ["Changing the filter", "{L}", "Before you start", "{M}", "{L}"]),
    ("<body><div class='container'><div class='row'><div class='col-sm-3'>{MENU}</div><div class='col-sm-9'><h2>A workshop by the sea</h2><p>{L}</p><p>{L}</p></div></div></div>", ["A workshop by the sea", "{L}", "{L}"]),
    ("<body><div id=a1><div id=a2>{MENU}</div><div id=a3><p>{L}</p><p>{L}</p><p>{M}</p></div></div>", ["{L}", "{L}", "{M}"]),
    ("<body><div class='layout__9Yx2'><div class='body__Zq81'><h1>Prices</h1><p>{L}</p><blockquote>{M}</blockquote><p>{L}</p></div></div>", ["Prices", "{L}", "{M}", "{L}"]),
    # no names at all
    ("<body><p>{L}</p><p>{L}</p></body>", ["{L}", "{L}"]),
    ("<body><div><div>{MENU}</div><div><h1>The wall</h1><p>{L}</p><p>{M}</p></div><div>{FOOT}</div></div>", ["The wall", "{L}", "{M}"]),
    ("<body><center><h1>The wall</h1></center><p>{L}<p>{L}<p>{S}", ["The wall", "{L}", "{L}", "{S}"]),
    ("<body><table><tr><td>{MENU}</td><td><h1>The wall</h1><p>{L}</p><p>{L}</p></td></tr></table>", ["The wall", "{L}", "{L}"]),
    ("<body><section><h1>Letters</h1><p>{L}</p></section><section><h2>Answers</h2><p>{L}</p><p>{M}</p></section><footer>{FOOT}</footer>", ["Letters", "{L}", "Answers", "{L}", "{M}"]),
    ("<html><body><h1>Only a title and a text</h1>{L}<br><br>{L}</body></html>", ["Only a title and a text", "{L} {L}"]),
    # articles with parts that have names
    ("<body><nav>{MENU}</nav><article><p class='lead'>{M}</p><p>{L}</p><p class='footnote'>{M}</p></article>", ["{M}", "{L}", "{M}"]),
    ("<body><article><p class=\"lead\">{M}</p><p class=\"footnote\">{S}</p></article><footer>{FOOT}</footer>", ["{M}", "{S}"]),
    ("<body><article><h1>The wall</h1><p>{L}</p><section class='note'><p>{L}</p></section><p>{L}</p></article>", ["The wall", "{L}", "{L}", "{L}"]),
    ("<body><article><p>{L}</p><ul><li><a href=/x>The first report</a></li><li><a href=/y>The second report</a></li></ul><p>{L}</p></article>", ["{L}", "The first report", "The second report", "{L}"]),
    ("<body><article><header><h1>Big Title</h1></header><p>{L}</p><p>{L}</p></article><footer>{FOOT}</footer>", ["Big Title", "{L}", "{L}"]),
    ("<body><article><h1>The wall</h1><div class='byline'>By Anna Lind</div><p>{L}</p><p>{L}</p></article>", ["The wall", "By Anna Lind", "{L}", "{L}"]),
    ("<body><article><h1>The wall</h1><p class='author'>By Anna Lind</p><p>{L}</p><p>{L}</p></article>", ["The wall", "By Anna Lind", "{L}", "{L}"]),
    ("<body><article><p>{L}</p><xmp>if a < b: print(a)</xmp><p>{L}</p></article>", ["{L}", "if a < b: print(a)", "{L}"]),
    ("<body><main><h1>How to</h1><ol><li>{M}</li><li>{M}</li><li>{M}</li></ol><p>{L}</p></main>", ["How to", "{M}", "{M}", "{M}", "{L}"]),
    ("<body><main><h1>Terms</h1><dl><dt>Weir</dt><dd>{M}</dd><dt>Sluice</dt><dd>{M}</dd></dl><p>{L}</p></main>", ["Terms", "Weir", "{M}", "Sluice", "{M}", "{L}"]),
    ("<body><article><figure><img src=a.jpg><figcaption>The bridge in May.</figcaption></figure><p>{L}</p><p>{L}</p></article>", ["The bridge in May.", "{L}", "{L}"]),
    ("<body><article><p>{L}</p><table><tr><td>Year</td><td>Level</td></tr><tr><td>1990</td><td>Low.</td></tr></table><p>{L}</p></article>", ["{L}", "Year", "Level", "1990", "Low.", "{L}"]),
    ("<body><article><p>{L}</p><pre>make all</pre><p>{M}</p></article>", ["{L}", "make all", "{M}"]),
    ("<body><div class='entry-content'><div class='wp-block-group'><p>{L}</p></div><div class='wp-block-quote'><p>{M}</p></div><p>{L}</p></div>", ["{L}", "{M}", "{L}"]),
    # what has to go
    ("<body><header><a href=/>Harbour Post</a></header><article><p>{L}</p><div class='ad'>Buy two boats now, get one.</div><p>{L}</p></article>", ["{L}", "{L}"]),
    ("<body><div class='cookie-banner'><p>We use cookies to make this site better. You can say no.</p><button>Fine</button></div><main><h1>The wall</h1><p>{L}</p><p>{L}</p></main>", ["The wall", "{L}", "{L}"]),
    ("<body><main><p>{L}</p><p>{L}</p></main><aside><h3>Also read</h3>{MENU}</aside>", ["{L}", "{L}"]),
    ("<body><article><p>{L}</p><p>{L}</p></article><section class='comments'><h3>Two comments</h3><div class='comment'><b>Kai</b><p>{M}</p></div><div class='comment'><b>Ida</b><p>{M}</p></div></section>", ["{L}", "{L}"]),
    ("<body><article><p>{L}</p><p>{M}</p></article><div class='newsletter'><h3>Get our letter</h3><p>Every Friday, for nothing.</p><form><input><button>Go</button></form></div>", ["{L}", "{M}"]),
    ("<body><article><p>{L}</p><p>{L}</p></article><div class='related-posts'><h3>More on this</h3><ul><li><a href=1>Boats of the north</a></li><li><a href=2>Where the eels went</a></li></ul></div><footer>{FOOT}</footer>", ["{L}", "{L}"]),
    ("<body><form action=/search><label>Search the site</label><input name=q><button>Go</button></form><main><p>{L}</p><p>{L}</p></main>", ["{L}", "{L}"]),
    ("<body><div class='breadcrumbs'><a href=/>Home</a> &gt; <a href=/n>News</a></div><main><h1>The wall</h1><p>{L}</p></main>", ["The wall", "{L}"]),
    ("<body><article><p>{L}</p><p>{L}</p></article><div class='share-buttons'><a href=#>Mail</a> <a href=#>Print</a> <a href=#>Copy</a></div>", ["{L}", "{L}"]),
    ("<body><div id='sidebar'><h3>About</h3><p>A paper for the coast.</p></div><div id='content'><p>{L}</p><p>{L}</p></div><div id='footer'>{FOOT}</div>", ["{L}", "{L}"]),
    ("<body><script>var a='<p>no</p>';</script><style>p{{color:red}}</style><noscript>Turn it on.</noscript><article><p>{L}</p><p>{M}</p></article>", ["{L}", "{M}"]),
    ("<body><div class='popup'><h3>Wait</h3><p>Take our offer before you go.</p><form><button>Yes</button></form></div><div class='story'><h1>The wall</h1><p>{L}</p><p>{L}</p></div>", ["The wall", "{L}", "{L}"]),
    ("<body><nav class='x81hq'>{MENU}</nav><div class='k20sd'><p>{L}</p><p>{L}</p><p>{L}</p></div><footer class='z77'>{FOOT}{MENU}</footer>", ["{L}", "{L}", "{L}"]),
    ("<body><div class='tm-header'>{MENU}</div><div class='tm-page'><h1>The wall</h1><p>{L}</p><p>{S}</p><p>{L}</p></div><div class='tm-foot'>{FOOT}</div>", ["The wall", "{L}", "{S}", "{L}"]),
    # inline markup, links, languages of attributes
    ("<body><div role='main'><h1>The wall</h1><p>{L} See <a href=/x>the map</a>.</p><p><b>{M}</b></p></div>", ["The wall", "{L} See the map.", "{M}"]),
    ("<body><main><p>{L}</p><p><a href=/x>{M}</a></p><p>{L}</p></main>", ["{L}", "{M}", "{L}"]),
    ("<body><div class='artikel'><h1>Der Damm</h1><p>{L}</p><p>{L}</p></div><div class='fuss'>{FOOT}</div>", ["Der Damm", "{L}", "{L}"]),
    ("<body><div class='contenido'><h1>El muro</h1><p>{L}</p><p>{M}</p><p>{L}</p></div>", ["El muro", "{L}", "{M}", "{L}"]),
    ("<body><div class='td-ss-main-content'><h1>The wall</h1><p>{L}</p><p>{L}</p></div><div class='td-footer-wrapper'>{FOOT}</div>", ["The wall", "{L}", "{L}"]),
    ("<body><div class='ember-view'><div class='ember-view'><p>{L}</p></div><div class='ember-view'><p>{L}</p><p>{M}</p></div></div>", ["{L}", "{L}", "{M}"]),
    ("<body><nav>{MENU}</nav><div class='post'>{L}<br><br>{L}<br><br>{M}</div>", ["{L} {L} {M}"]),
    ("<body><div class='q-text'><span>{L}</span></div><div class='q-text'><span>{L}</span></div>", ["{L}", "{L}"]),
    ("<body><nav>{MENU}</nav><article class='h-entry'><h1 class='p-name'>The wall</h1><div class='e-content'><p>{L}</p><p>{L}</p></div></article>", ["The wall", "{L}", "{L}"]),
]


def made(template: str, blocks: list[str]) -> tuple[str, list[str]]:
    """A page and its blocks, with the same texts in both."""

    def fill(texts: list[str]) -> list[str]:
        next_ = {"L": itertools.cycle(LONG), "M": itertools.cycle(MIDDLE), "S": itertools.cycle(SHORT)}
        return [re.sub(r"\{([LMS])\}", lambda m: next(next_[m[1]]), t) for t in texts]

    # the article's texts come first in each page that has others, so both count alike
    return fill([template.replace("{MENU}", MENU).replace("{FOOT}", FOOT).replace("{{", "{").replace("}}", "}")])[0], fill(blocks)
