"""A transport without a network: answers by address, with invented records."""

import json

PMID, OTHER = "90210001", "90210002"
_FIRST = f"""
<PubmedArticle>
 <PubmedData>
  <ReferenceList><Reference><ArticleIdList><ArticleId IdType="Doi">10.5555/cited.7</ArticleId></ArticleIdList></Reference></ReferenceList>
  <ArticleIdList><ArticleId IdType="pmc">PMC900001</ArticleId></ArticleIdList>
 </PubmedData>
 <MedlineCitation>
  <Article>
   <AuthorList>
    <Author><ForeName>Ines</ForeName><LastName>Calder</LastName></Author>
    <Author><LastName>Osei</LastName></Author>
    <Author><CollectiveName>Harbour Margin Consortium</CollectiveName></Author>
    <Author><Identifier>none</Identifier></Author>
   </AuthorList>
   <ArticleTitle>Grading of <sup>2</sup>H-labelled <i>cores</i>: a <b>bench</b> comparison</ArticleTitle>
   <Abstract>
    <AbstractText Label="AIM">To compare <i>two</i> stains.</AbstractText>
    <AbstractText Label="SETTING"> </AbstractText>
    <AbstractText>Cores were read twice.</AbstractText>
    <AbstractText Label="OUTCOME">Readers agreed.</AbstractText>
   </Abstract>
   <Journal><Title>Annals of Invented Morphology</Title><JournalIssue><PubDate><Year>2031</Year><Month>Mar</Month></PubDate></JournalIssue></Journal>
   <PublicationTypeList><PublicationType>Comparative Study</PublicationType><PublicationType>Letter</PublicationType></PublicationTypeList>
   <ArticleDate><Day>9</Day></ArticleDate>
  </Article>
  <PMID>{PMID}</PMID>
 </MedlineCitation>
</PubmedArticle>"""
_SECOND = f"""
<PubmedArticle><MedlineCitation><PMID>{OTHER}</PMID><Article><ArticleTitle>Second record</ArticleTitle>
 <ArticleDate><Year>2030</Year><Month>11</Month><Day>2</Day></ArticleDate></Article></MedlineCitation>
 <PubmedData><ArticleIdList><ArticleId IdType="doi">10.5555/second</ArticleId></ArticleIdList></PubmedData></PubmedArticle>"""
ARTICLES = f"<PubmedArticleSet>{_FIRST}{_SECOND}</PubmedArticleSet>"


def get(url: str) -> str:
    if "esearch" in url:
        return json.dumps({"esearchresult": {"idlist": [PMID, OTHER] if "surgical" in url else []}})
    if "efetch" in url:
        return ARTICLES
    if "europepmc" in url:
        return json.dumps({"resultList": {"result": [{"title": " T ", "doi": "10.1/e", "authorString": "A, B", "pubYear": "2026"}]}})
    return json.dumps({"collection": [{"title": "P", "date": "2026-05-01", "doi": "10.1/p", "authors": "A; B", "category": "pathology"}]})


def fail(url: str) -> str:
    raise RuntimeError("no network")
