"""Rows of the operator inventory that are not rebuilt as queries, with the reason."""

NOT_APPLICABLE = {
    "model calls": ([158, 161, 188, 221, 244, 345], "need a language model, NLI model or parser; deterministic gates around them are rebuilt where they have any"),
    "office files": ([7, 9], "read and write spreadsheets, for which no library is installed"),
    "device and service control": ([310, 311, 313], "server-sent events, pub/sub and locks of a service; Spark has one writer"),
    "plug-in protocols": ([21, 22, 326, 327, 328, 329, 330, 331, 332], "registries and adapters; the query registry and the rule classes take their place"),
    "driver-side planning": ([120, 279, 280, 282, 295], "small loops over a plan in the driver, no work on data"),
}
