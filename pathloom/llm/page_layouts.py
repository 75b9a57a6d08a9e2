"""Labelled pages to learn from: parts of common page layouts, each slot of which is known to be main text or not.

``{h}``, ``{p}`` and ``{s}`` are slots of main text (heading, paragraph, phrase);
``{N}``, ``{B}`` and ``{L}`` of other text (name, sentence, paragraph). What is
in brackets is repeated.
"""

from __future__ import annotations

import re

import numpy as np

#: Mark the first character of a slot's text.
MAIN, OTHER = "\ue000", "\ue001"

HEADERS = ['<header class="site-header"><a href="/">{N}</a><p>{B}</p></header>', '<div id="header"><h1><a href="/">{N}</a></h1><span>{B}</span></div>', '<div class="masthead">{N} {N}</div>', '<header role="banner"><h2>{B}</h2></header>', '<div class="top-bar">{B}</div>', "<header>{N}</header>", "<header><h1>{N}</h1><p>{B}</p></header>", '<div class="logo">{N}</div>']
MENUS = ['<nav><ul>[<li><a href="#">{N}</a></li>]</ul></nav>', '<div class="menu">[<a href="#">{N}</a>]</div>', '<ul id="nav">[<li><a href="#">{N}</a>]</ul>', '<div class="breadcrumbs"><a href="#">{N}</a> &gt; <a href="#">{N}</a></div>', '<table class="navbar"><tr>[<td><a href="#">{N}</a></td>]</tr></table>', '<div role="navigation">[<a href="#">{N}</a> | ]</div>', "<ul>[<li><a href=\"#\">{N}</a></li>]</ul>", '<nav class="main-menu">[<div><a href="#">{N}</a></div>]</nav>', "<menu>[<li>{N}</li>]</menu>"]
NOTICES = ['<div class="cookie-notice"><p>{B}</p><button>{N}</button></div>', '<div id="consent" role="dialog">{B}</div>', '<p class="notice">{B}</p>', '<div class="alert alert-info"><p>{B}</p></div>', '<section class="notification">{B}</section>', '<div class="notice"><p>{L}</p></div>', "<dialog open>{B}</dialog>", '<div class="cookie-banner">{L}<button>{N}</button></div>']
ADVERTS = ['<div class="ad">{B}</div>', '<div class="advertisement"><a href="#">{B}</a></div>', '<aside class="promo"><p>{B}</p></aside>', '<ins class="adsbygoogle">{B}</ins>', '<div id="sponsor-box"><h4>{N}</h4><p>{B}</p></div>', '<div class="ad-slot">{B} {B}</div>', '<div class="ads"><p>{L}</p></div>', '<p class="sponsored">{B}</p>']
SIDES = ['<aside><h3>{N}</h3><ul>[<li><a href="#">{B}</a></li>]</ul></aside>', '<div class="sidebar"><h4>{N}</h4><p>{B}</p></div>', '<div id="right-rail" class="widget">[<p>{B}</p>]</div>', '<aside class="related">[<p>{B}</p>]</aside>', "<aside><p>{L}</p></aside>", '<div class="sidebar">[<p>{L}</p>]</div>', '<section class="related-posts"><h3>{N}</h3>[<div><a href="#">{B}</a></div>]</section>', '<div class="widget"><h3>{N}</h3><ul>[<li>{N}</li>]</ul></div>']
FORMS = ['<form action="/s"><label>{N}</label><input name="q"><button>{N}</button></form>', '<form class="newsletter"><p>{B}</p><input type="email"></form>', '<div class="signup"><form><h3>{B}</h3></form></div>', '<div class="search">{N}</div>', "<form><p>{L}</p><button>{N}</button></form>", "<form><fieldset><legend>{N}</legend>[<p><label>{N}</label><input></p>]</fieldset></form>"]
TALK = ['<section class="comments"><h2>{N}</h2>[<div class="comment"><b>{N}</b><p>{L}</p></div>]</section>', '<div id="comments"><ol>[<li class="comment-item"><p>{L}</p></li>]</ol></div>', '<div class="discussion">[<article class="comment"><p>{L}</p></article>]</div>', '<ul class="replies">[<li>{L}</li>]</ul>', '<section id="comments">[<article><header>{N}</header><p>{L}</p></article>]</section>', '<div class="comment-list">[<p>{B}</p>]</div>', '<div class="reviews">[<blockquote>{L}</blockquote>]</div>']
FOOTERS = ["<footer>&copy; {N} &middot; {B}</footer>", '<div id="footer"><p>{B}</p><ul>[<li><a href="#">{N}</a></li>]</ul></div>', '<footer class="site-footer"><p>&copy; {B}</p></footer>', '<div class="legal">{B}</div>', '<div role="contentinfo">{B}</div>', "<footer><p>{L}</p></footer>", "<footer>[<p>{B}</p>]</footer>", '<div class="footer">{B}</div>']
SHARES = ['<div class="share"><a href="#">{N}</a> <a href="#">{N}</a></div>', '<ul class="social">[<li><a href="#">{N}</a></li>]</ul>', '<p class="tags">[<a href="#">{N}</a> ]</p>', "<footer><p>{B}</p></footer>"]
ARTICLES = ["<article><h1>{h}</h1>%s</article>", "<article>%s</article>", "<main><h1>{h}</h1>%s</main>", '<div class="content"><h1>{h}</h1>%s</div>', '<div id="post-body"><h2>{h}</h2>%s</div>', "<main><article><header><h1>{h}</h1></header>%s</article></main>", '<div class="entry">%s</div>', '<section class="story"><h1>{h}</h1>%s</section>', '<table><tr><td class="main-text">%s</td></tr></table>', "<div><h1>{h}</h1>%s</div>", '<div role="main">%s</div>', '<article class="post"><h2>{h}</h2>%s</article>', '<div class="article-body">%s</div>', "<section><h1>{h}</h1>%s</section>"]
BODIES = ["[<p>{p}</p>]", "[<p>{p}</p>]<h2>{h}</h2>[<p>{p}</p>]", "[<p>{p}]", "[<p>{p}</p>]<ul>[<li>{s}</li>]</ul>[<p>{p}</p>]", "<p>{p}</p><blockquote><p>{p}</p></blockquote>[<p>{p}</p>]", "[<div>{p}</div>]", "{p}<br><br>{p}<br>", "<p>{p}</p><table>[<tr><td>{s}</td><td>{s}</td></tr>]</table><p>{p}</p>", "<pre>{p}</pre>[<p>{p}</p>]", "<figure><img src=a><figcaption>{s}</figcaption></figure>[<p>{p}</p>]", '[<p>{p} <a href="#">{s}</a> {p}</p>]', "<p>{h}</p>[<p>{p}</p>]<ol>[<li>{p}</li>]</ol>", "<h3>{h}</h3>[<p><b>{p}</b><br><p>{p}</p>]", "<section><h2>{h}</h2>[<p>{p}</p>]</section><section><h2>{h}</h2>[<p>{p}</p>]</section>"]


def labelled_page(random: np.random.RandomState, words: list[str]) -> str:
    """One page of these parts, its slots filled with ``words`` and marked."""
    def some(n: int) -> str:
        return " ".join(words[k] for k in random.randint(0, len(words), n))

    def slot(m: re.Match) -> str:
        low, high, end = {"h": (2, 11, ""), "p": (1, 15, ".") if random.rand() < 0.3 else (12, 100, "."), "s": (1, 9, ""), "N": (1, 3, ""), "B": (3, 16, "." * random.randint(2)), "L": (12, 60, ".")}[m[1]]
        return (MAIN if m[1].islower() else OTHER) + some(random.randint(low, high)) + end

    def one(parts: list[str], share: float) -> str:
        return parts[random.randint(len(parts))] if random.rand() < share else ""

    body = one(BODIES, 1)
    for k in range(random.randint(0, 3)):
        body += one([*ADVERTS, *SHARES, *NOTICES, *SIDES, *FORMS], 0.5) + one(BODIES, 1)
    body += one(SHARES, 0.2) + one(TALK, 0.25)
    around = [one(HEADERS, 0.6), one(MENUS, 0.8), one(NOTICES, 0.35), one(ADVERTS, 0.4)]
    random.shuffle(around)
    after = [one(SIDES, 0.5), one(TALK, 0.35), one(FORMS, 0.35), one(ADVERTS, 0.3), one(NOTICES, 0.15)]
    random.shuffle(after)
    wrap = one(["%s", "<div class=\"page\">%s</div>", "<div id=\"content\">%s</div>", "<div class=\"wrapper\"><div>%s</div></div>"], 1)
    if random.rand() < 0.12:
        around, after = [], []  # an article alone
    page = "".join(around) + wrap.replace("%s", one(ARTICLES, 1).replace("%s", body) + "".join(after)) + one(FOOTERS, 0.8)
    page = re.sub(r"\[([^\[\]]*)\]", lambda m: m[1] * random.randint(1, 7), page)
    return "<html><body>" + re.sub(r"\{(\w)\}", slot, page) + "</body></html>"
