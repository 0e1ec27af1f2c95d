"""A search server of 25 documents for the remote source."""

DOCS = [{"_id": f"d{k:02d}", "_source": {"@timestamp": k, "message": f"m{k}"}, "sort": [k, f"d{k:02d}"]} for k in range(25)]


def ask(request):
    part = request.get("slice")
    hits = [d for k, d in enumerate(DOCS) if not part or k % part["max"] == part["id"]]
    if "search_after" in request:
        hits = [d for d in hits if d["sort"] > request["search_after"]]
    return hits[: request["size"]]
