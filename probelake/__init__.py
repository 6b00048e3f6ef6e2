"""probelake: Spark operators for tables of physical objects and what they do when acted on."""
