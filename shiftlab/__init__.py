"""shiftlab: Spark-native evaluation of classifiers under domain shift.

Sub-packages:

- ``sources``   scans and sinks (item tables, class prompts, grid configs, reports, logs)
- ``functions`` column-level vector functions (normalise, softmax, argmax, standardise)
- ``operators`` DataFrame operators (scoring, metrics, retrieval, selection, sampling, experiments)
- ``plans``     whole jobs built from the operators (zero-shot, retrieval, report, linear probe, curves)
- ``streaming`` Structured Streaming variants of top-N retrieval and evaluation counting
"""

__version__ = "0.1.0"

# Fixed split vocabulary: names and their report order.
SPLITS = ["train", "id_val", "id_test", "val", "test"]
SPLIT_LABELS = {
    "train": "Train",
    "id_val": "ID Val",
    "id_test": "ID Test",
    "val": "OOD Val",
    "test": "OOD Test",
}
