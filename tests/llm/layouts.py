"""Hand-made pages of many layouts, none of them made by the generator, and their main texts."""

A = [
    "The river had been rising for three days before anyone in the valley thought to move the boats.",
    "By Thursday the lower road was gone, and the schoolhouse, which stands on a small hill, had become an island.",
    "Nobody was hurt. The mayor said that the town would rebuild the bridge in spring, with help from the county.",
    "Farmers on the east bank lost some hay, two sheds and a tractor, but most of the cattle had been moved in time.",
]
B = [
    "Sourdough needs patience more than skill. Feed the starter the night before, and keep it warm.",
    "Mix flour, water and salt; wait an hour; fold the dough four times, with half an hour between folds.",
    "Bake it in a hot pot with the lid on for twenty minutes, then without the lid until it is dark.",
]


def ps(texts):
    return "".join(f"<p>{t}</p>" for t in texts)


NAV = "<ul><li><a href=/>Home</a></li><li><a href=/n>News</a></li><li><a href=/s>Sport</a></li><li><a href=/a>About us</a></li></ul>"

LAYOUTS = {
    "semantic": (
        f"<body><header><nav>{NAV}</nav></header><main><article><h1>Flood in the valley</h1>{ps(A)}</article></main>"
        "<aside><h3>Most read</h3><ul><li><a href=1>One story here</a></li><li><a href=2>Another story</a></li></ul></aside><footer><p>&copy; 2024 The Valley Post</p></footer></body>",
        ["Flood in the valley", *A],
    ),
    "misleading section name": (f'<body><nav>{NAV}</nav><article><h1>Bread</h1><section class="sidebar-note">{ps(B)}</section></article><footer>&copy; 2020 Bakers</footer></body>', ["Bread", *B]),
    "neutral divs": (
        f'<body><div class="c1"><div class="row">{NAV}</div></div><div class="c2"><div class="x"><h1>Flood in the valley</h1>{ps(A)}</div></div>'
        '<div class="c3"><ul><li><a href=1>One story here</a></li><li><a href=2>Another story</a></li><li><a href=3>A third one</a></li></ul></div><div class="c4">&copy; 2024 The Valley Post. All rights reserved.</div></body>',
        ["Flood in the valley", *A],
    ),
    "table layout": (
        f"<body><table><tr><td colspan=2>{NAV}</td></tr><tr><td width=150><a href=1>Archive</a><br><a href=2>Links</a><br><a href=3>Contact</a></td><td><h2>Sourdough for beginners</h2>{ps(B)}</td></tr>"
        "<tr><td colspan=2>&copy; 1999 Baker's page</td></tr></table></body>",
        ["Sourdough for beginners", *B],
    ),
    "definitions, a linked paragraph, a short div": (
        f"<body><nav>{NAV}</nav><article><h1>Terms of the trade</h1>{ps(B)}<dl><dt>Crumb</dt><dd>The inside of the loaf.</dd><dt>Crust</dt><dd>The outside, baked dark and hard.</dd></dl>"
        "<p><a href=/long>The long version of this recipe, with pictures of every step</a></p><div>Serves four.</div></article><footer><p>&copy; 2021 Bread and so on</p></footer></body>",
        ["Terms of the trade", *B, "Crumb", "The inside of the loaf.", "Crust", "The outside, baked dark and hard.", "The long version of this recipe, with pictures of every step", "Serves four."],
    ),
    "unnamed notice and copyright": (
        f"<body><div><p>We use cookies to make this site work. By going on you accept them.</p><button>Accept</button></div><nav>{NAV}</nav><main><h1>Flood in the valley</h1>{ps(A)}</main><p>&copy; 2023 The Valley Post</p></body>",
        ["Flood in the valley", *A],
    ),
    "comments and form": (
        f'<body><div id="top">{NAV}</div><div class="post"><h1>Sourdough for beginners</h1>{ps(B)}</div><div class="comments"><h3>Comments</h3><div class="comment"><p>Great, thanks! It worked the first time.</p></div>'
        '<div class="comment"><p>Mine came out flat. What did I do wrong?</p></div></div><form action=/c><label>Your comment</label><textarea name=t></textarea><button>Send</button></form></body>',
        ["Sourdough for beginners", *B],
    ),
    "wrapper named like a menu": (f'<body><div class="menu-guide"><h1>Sourdough for beginners</h1>{ps(B)}</div><div class="footer">&copy; 2022 Menu guide, all rights reserved</div></body>', ["Sourdough for beginners", *B]),
    "list article": (
        f"<body><header>{NAV}</header><section><h1>Four things about the flood</h1><ol>{''.join(f'<li>{t}</li>' for t in A)}</ol></section><aside><p>Subscribe to our letter.</p><form><input name=m><button>Go</button></form></aside></body>",
        ["Four things about the flood", *A],
    ),
    "quote, figure and code": (
        f"<body><nav>{NAV}</nav><div class=entry><h1>On floods</h1><p>{A[0]}</p><blockquote><p>{A[2]}</p></blockquote><figure><img src=f.jpg><figcaption>The lower road on Friday</figcaption></figure><p>{A[1]}</p><pre>level = 4.2</pre></div></body>",
        ["On floods", A[0], A[2], "The lower road on Friday", A[1], "level = 4.2"],
    ),
    "advert inside": (
        f'<body><article><h1>Flood in the valley</h1><p>{A[0]}</p><div class="ad-slot"><a href=/x>Cheap boats, this week only!</a></div><p>{A[1]}</p><p>{A[2]}</p><div class="related"><h3>Related</h3>{NAV}</div></article></body>',
        ["Flood in the valley", *A[:3]],
    ),
    "text without blocks": (f"<body>{NAV}<div>{A[0]}<br>{A[1]}<hr>{A[2]}</div></body>", [f"{A[0]} {A[1]}", A[2]]),
    "only paragraphs": (f"<html><body>{ps(A)}</body></html>", A),
    "many divs as paragraphs": (f"<body><div class=hd>{NAV}</div><div class=bd><h1>Flood in the valley</h1>{''.join(f'<div>{t}</div>' for t in A)}</div><div class=ft>&copy; 2018</div></body>", ["Flood in the valley", *A]),
}


def score(extract):
    """Block precision and recall over all layouts, and what is wrong."""
    right = found = true = 0
    wrong = {}
    for name, (source, want) in LAYOUTS.items():
        got = [b for b in extract(source).split("\n\n") if b]
        hit = sum(b in want for b in got)
        right, found, true = right + hit, found + len(got), true + len(want)
        if got != want:
            wrong[name] = ([b for b in got if b not in want], [b for b in want if b not in got])
    return 2 * right / (found + true), wrong
