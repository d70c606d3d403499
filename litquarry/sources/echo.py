"""A transport without a network: every answer repeats what was asked, in the form of the service that was asked."""

from __future__ import annotations

import json
import urllib.parse


def answer(url: str) -> str:
    """Ids of a search are the length of its text and 7; other answers carry the ids, the query or the days of the request."""
    where = urllib.parse.urlsplit(url)
    asked = {k: v[0] for k, v in urllib.parse.parse_qs(where.query).items()}
    if "term" in asked:
        return json.dumps({"esearchresult": {"idlist": [str(len(asked["term"])), " ", asked["retmax"]]}})
    if "id" in asked:
        each = "".join(f"<PubmedArticle><MedlineCitation><PMID>{i}</PMID><Article><ArticleTitle>Record {i}</ArticleTitle></Article></MedlineCitation></PubmedArticle>" for i in asked["id"].split(","))
        return f"<PubmedArticleSet>{each}</PubmedArticleSet>"
    if "query" in asked:
        return json.dumps({"resultList": {"result": [{"title": asked["query"], "pmid": asked["pageSize"], "source": "MED"}]}})
    server, start, end = where.path.split("/")[2:5]
    return json.dumps({"collection": [{"title": f"{server} from {start} to {end}", "date": start, "category": "all"}]})
