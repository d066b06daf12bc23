"""meshfield: queries on fields defined on meshes, as Spark plans."""
