"""Files for other programs: rasters, tensors, patch sets and documents."""
