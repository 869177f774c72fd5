"""The closed vocabulary, the ontology and the shapes as plain values."""

from __future__ import annotations

# Entity types.
ENTITY_TYPES = ["Note", "Person", "Project", "Reference", "Feedback", "Decision", "Claim", "Source", "Tool", "Event", "Concept"]

# Predicates.
PREDICATES = [
    "mentions", "about", "is_part_of", "authored_by", "created_by", "supersedes", "blocks", "depends_on",
    "decides", "supports", "refutes", "derived_from", "broader", "narrower", "related", "has_status",
]

# Predicates with one object at most.
FUNCTIONAL = ["has_status", "supersedes"]

# File name prefixes and the types they stand for.
PREFIX_TYPES = {"project_": "Project", "reference_": "Reference", "feedback_": "Feedback", "user_": "Person"}

# Parts of a line that tell its relation, in order; then those of a heading.
LINE_CUES = [("supersed", "supersedes"), ("block", "blocks"), ("depend", "depends_on"), ("part of", "is_part_of"), ("decid", "decides")]
HEADING_CUES = [("supersede", "supersedes"), ("decision", "decides"), ("decide", "decides")]

# Folders that a walk leaves out.
SKIPPED_FOLDERS = [".git", ".venv", "node_modules", "__pycache__", ".pytest_cache"]

NAMESPACE = "urn:kgspark:ns#"
RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
SCHEMA = "https://schema.org/"
SKOS = "http://www.w3.org/2004/02/skos/core#"
XSD = "http://www.w3.org/2001/XMLSchema#"
OWL = "http://www.w3.org/2002/07/owl#"

# The superclass of each class that has one.
SUPERCLASS = {
    "Note": SCHEMA + "CreativeWork",
    "Person": SCHEMA + "Person",
    "Project": SCHEMA + "Project",
    "Reference": SCHEMA + "CreativeWork",
    "Feedback": SCHEMA + "Comment",
    "Claim": SCHEMA + "Claim",
    "Source": SCHEMA + "CreativeWork",
    "Tool": SCHEMA + "SoftwareApplication",
    "Event": SCHEMA + "Event",
    "Concept": SKOS + "Concept",
}

# Superproperties (a name without a scheme is in NAMESPACE), transitive properties, ranges.
SUPERPROPERTY = {"supersedes": "supersedesTransitively", "broader": SKOS + "broader", "narrower": SKOS + "narrower"}
TRANSITIVE = ["supersedesTransitively"]
RANGE = {"authored_by": "Person", "created_by": "Person"}

#: A short list of function words; a parameter wherever it is used.
STOPWORDS = ["a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "in", "is", "it", "of", "on", "or", "that", "the", "to", "was", "with"]

REFUSAL = "I can't answer that from the notes I have."
