"""Small literal inputs shared by the tests."""

import base64

#: Three articles of different make: all fields, no venue and a wrapped label, no link in the heading.
DIGEST_HTML = """<!DOCTYPE html><html><body><table><tr><td>
<p>New for you, from <a href="https://www.scholar-inbox.com/digest">scholar-inbox.com</a></p>
<article class="entry"><div style="font-size:9px;display:inline;float:right;">Geophysical Letters, 2023</div>
<h2>1. <a href="https://arxiv.org/abs/2305.01234v3" target="_blank">Glacier melt &amp; runoff</a></h2>
<span class="tag">cryosphere</span><span class="score">Relevance: 93</span><p>I. Haugen, Y. Batbayar, O. Nwosu</p></article>
<article class="entry"><h2><a href='https://papers.example.net/basalt?v=2&amp;f=pdf'>Columnar basalt<br>cooling</a></h2>
<p>S. Quispe</p><span><i>Relevance: 41</i></span></article>
<article class="entry"><h2>Editorial note</h2><p>The editors</p><span>Relevance: n/a</span></article>
</td></tr></table></body></html>"""


def b64url(s: str) -> str:
    return base64.urlsafe_b64encode(s.encode()).decode()


def message(mid="inbox-7f", html=DIGEST_HTML, headers=None, parts=None, body=True, received=None):
    if headers is None:
        headers = [("From", "digest@mail.example.net"), ("Date", "Tue, 09 May 2023 06:45:10 +0200"),
                   ("Subject", "Your weekly Scholar Alert: 3 new papers")]
    return {
        "id": mid, "threadId": "t" + mid, "labelIds": ["INBOX"], "snippet": "s",
        "internalDate": received,
        "payload": {
            "headers": [{"name": n, "value": v} for n, v in headers],
            "body": {"data": b64url(html) if (body and html is not None) else None},
            "parts": parts,
        },
    }
