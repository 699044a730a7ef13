"""Reading and writing: schemas, landed files, and the domain tables."""
