"""Run options, platform presets and their validation."""

from __future__ import annotations

from dataclasses import dataclass, field, fields, replace

# Default gene exclusions of the platforms.
XENIUM_CONTROLS = "^(Deprecated|NegControl|Unassigned|Intergenic)"
COSMX_CONTROLS = "^(FalseCode|SystemControl|NegPrb|Negative)"
INIT_ITERATIONS = 20


@dataclass(frozen=True)
class Columns:
    """Input column names and the values that mean nuclear or unassigned."""

    gene: str | None = None
    transcript_id: str | None = None
    x: str | None = None
    y: str | None = None
    z: str | None = None
    compartment: str | None = None
    compartment_nuclear: str | None = None
    fov: str | None = None
    cell_id: str | None = None
    cell_id_unassigned: str | None = None
    cell_assignment: str | None = None
    cell_assignment_unassigned: str | None = None
    qv: str | None = None


@dataclass(frozen=True)
class Options:
    columns: Columns = field(default_factory=Columns)
    preset: str | None = None
    # input
    excluded_genes: str | None = None
    include_neg_ctrls: bool = False
    min_qv: float | None = None
    ignore_z_coord: bool = False
    coordinate_scale: float | None = None
    non_unique_cell_ids: bool = False
    use_cell_initialization: bool = False
    max_transcript_nucleus_distance: float = 60.0
    # prior segmentation
    nuclear_reassignment_prob: float = 0.2
    prior_seg_reassignment_prob: float = 0.5
    expand_initialized_cells: int = 0
    cellpose_masks: str | None = None
    cellpose_masks_fixed: str | None = None
    cellpose_cellprobs: str | None = None
    cellpose_cellprob_discount: float = 0.85
    cellpose_scale: float | None = None
    cellpose_x_transform: tuple[float, float, float] | None = None
    cellpose_y_transform: tuple[float, float, float] | None = None
    compat_mask_prior: bool = False
    unmodeled_fixed_cells: bool = False
    spaceranger_barcode_mappings: str | None = None
    zarr_shape: str | None = None
    zarr_shape_geometry_column: str = "geometry"
    zarr_shape_cell_id_column: str = "cell_id"
    # grid
    voxel_layers: int = 4
    burnin_voxel_size: float | None = None
    voxel_size: float | None = None
    quad_size: float = 150.0
    density_bandwidth: float = 0.5
    density_bins: int = 5
    # schedule
    burnin_samples: int = 200
    samples: int = 200
    hillclimb: int = 50
    recorded_samples: int = 100
    init_iterations: int = INIT_ITERATIONS
    cooling_iters: int | None = None
    morphology_steps_per_iter: int = 4000  # a quarter of it is proposed in each quad
    sweeps_per_iter: int = 0  # above 0: so many sweeps of one proposal per cell in place of tile passes
    seed: int = 1
    check_consistency: bool = False
    # model
    ncomponents: int = 10
    nhidden: int = 100
    nunfactored: int = 300
    no_factorization: bool = False
    use_scaled_cells: bool = False
    use_mixture_weights: bool = False
    variable_burnin_dispersion: bool = False
    burnin_dispersion: float = 1.0
    dispersion: float | None = None
    hyperparam_e_phi: float = 1.0
    hyperparam_f_phi: float = 1.0
    hyperparam_neg_mu_phi: float = 1.0
    hyperparam_tau_phi: float = 0.1
    cell_compactness: float = 0.04
    ab_nihlo_bubble_prob: float = 0.05
    enforce_connectivity: bool = False
    # diffusion
    no_diffusion: bool = False
    diffusion_probability: float = 0.2
    diffusion_sigma_near: float | None = None
    diffusion_sigma_far: float | None = None
    diffusion_sigma_z: float = 0.1
    diffusion_proposal_sigma: float = 4.0
    diffusion_proposal_sigma_z: float = 0.2

    @property
    def final_voxel_size(self) -> float:
        return 1.0 if self.voxel_size is None else self.voxel_size

    @property
    def first_voxel_size(self) -> float:
        if self.burnin_voxel_size is not None:
            return self.burnin_voxel_size
        return max(2.0, self.final_voxel_size)

    @property
    def resolution_scale(self) -> int:
        return round(self.first_voxel_size / self.final_voxel_size)

    @property
    def sigma_near(self) -> float:
        return 1.0 if self.diffusion_sigma_near is None else self.diffusion_sigma_near

    @property
    def sigma_far(self) -> float:
        return 4.0 if self.diffusion_sigma_far is None else self.diffusion_sigma_far

    @property
    def mask_transforms(self) -> tuple[tuple[float, float, float], tuple[float, float, float]]:
        if self.cellpose_x_transform and self.cellpose_y_transform:
            return self.cellpose_x_transform, self.cellpose_y_transform
        s = 1.0 if self.cellpose_scale is None else self.cellpose_scale
        return (s, 0.0, 0.0), (0.0, s, 0.0)


@dataclass(frozen=True)
class Preset:
    """Values a platform fills in; explicit options win, ``forced`` ones do not ask."""

    columns: Columns
    excluded_genes: str | None = None
    defaults: dict = field(default_factory=dict)
    forced: dict = field(default_factory=dict)


# Column names and settings of the supported platforms.
PRESETS: dict[str, Preset] = {
    "xenium": Preset(
        Columns(
            gene="feature_name", transcript_id="transcript_id", x="x_location", y="y_location", z="z_location",
            compartment="overlaps_nucleus", compartment_nuclear="1", fov="fov_name", cell_id="cell_id",
            cell_id_unassigned="UNASSIGNED", qv="qv",
        ),
        XENIUM_CONTROLS, {"min_qv": 20.0, "cellpose_scale": 0.2125},
    ),
    "cosmx": Preset(
        Columns(
            gene="target", x="x_global_px", y="y_global_px", z="z", compartment="CellComp", compartment_nuclear="Nuclear",
            fov="fov", cell_id="cell", cell_id_unassigned="", cell_assignment="cell_ID", cell_assignment_unassigned="0",
        ),
        COSMX_CONTROLS, {"coordinate_scale": 0.12028}, {"non_unique_cell_ids": True},
    ),
    "cosmx_micron": Preset(
        Columns(
            gene="target", x="x", y="y", z="z", compartment="CellComp", compartment_nuclear="Nuclear",
            fov="fov", cell_id="cell_ID", cell_id_unassigned="0",
        ),
        COSMX_CONTROLS, {}, {"non_unique_cell_ids": True},
    ),
    "merscope": Preset(
        Columns(gene="gene", x="global_x", y="global_y", z="global_z", fov="fov", cell_id="cell_id", cell_id_unassigned="-1")
    ),
    "merfish": Preset(Columns(gene="gene", x="x", y="y", z="z", cell_id="cell", cell_id_unassigned="NA")),
    "visiumhd": Preset(
        Columns(gene="gene_id", x="x", y="y", z="z", cell_id="cell", cell_id_unassigned="0"), None,
        {"diffusion_sigma_near": 2.0, "diffusion_sigma_far": 8.0},
        {"burnin_voxel_size": 2.0, "voxel_size": 2.0, "voxel_layers": 1, "ignore_z_coord": True},
    ),
}


def complete(options: Options) -> Options:
    """Fill unset options from the preset and validate the result."""
    opts = options
    if opts.preset is not None:
        if opts.preset not in PRESETS:
            raise ValueError(f"unknown preset {opts.preset!r}; one of {sorted(PRESETS)}")
        p = PRESETS[opts.preset]
        merged = {
            f.name: getattr(opts.columns, f.name) if getattr(opts.columns, f.name) is not None else getattr(p.columns, f.name)
            for f in fields(Columns)
        }
        changes: dict = {"columns": Columns(**merged), **p.forced}
        if opts.excluded_genes is None and not opts.include_neg_ctrls:
            changes["excluded_genes"] = p.excluded_genes
        for name, value in p.defaults.items():
            if name == "cellpose_scale" and (opts.cellpose_x_transform or opts.cellpose_y_transform):
                continue
            if getattr(opts, name) is None:
                changes[name] = value
        opts = replace(opts, **changes)
    if opts.use_cell_initialization:
        opts = replace(opts, columns=replace(opts.columns, compartment=None, compartment_nuclear=None))
    return validate(opts)


def validate(opts: Options) -> Options:
    if not 1 <= opts.voxel_layers <= 256:
        raise ValueError("voxel_layers must be between 1 and 256")
    if not 1 <= opts.density_bins <= 16:
        raise ValueError("density_bins must be between 1 and 16")
    if opts.morphology_steps_per_iter < 1 or opts.sweeps_per_iter < 0:
        raise ValueError("morphology_steps_per_iter must be positive and sweeps_per_iter not negative")
    if opts.ncomponents < 1:
        raise ValueError("ncomponents must be positive")
    if opts.recorded_samples > opts.samples:
        raise ValueError("recorded_samples cannot exceed samples")
    if (opts.cellpose_x_transform is None) != (opts.cellpose_y_transform is None):
        raise ValueError("give both the x and the y mask transform, or neither")
    if opts.cellpose_masks and opts.spaceranger_barcode_mappings:
        raise ValueError("masks and barcode mappings exclude each other")
    if opts.preset == "visiumhd" and not (opts.cellpose_masks or opts.spaceranger_barcode_mappings or opts.zarr_shape):
        raise ValueError("binned counts need masks, barcode mappings or cell outlines as prior segmentation")
    ratio = opts.first_voxel_size / opts.final_voxel_size
    if ratio < 1.0 - 1e-5 or abs(ratio - round(ratio)) > 1e-5:
        raise ValueError("burnin_voxel_size must be a whole multiple of voxel_size")
    return opts
