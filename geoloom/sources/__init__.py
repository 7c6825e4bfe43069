"""Reading, cataloguing, versioning and writing layers."""
