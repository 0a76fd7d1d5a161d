"""All query modules outside the optional subpackage."""

from fundloom.plans import aggregates, classification, cleaning, discovery, joins, references

MODULES = [references, cleaning, joins, aggregates, classification, discovery]
